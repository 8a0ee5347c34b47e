"""Ways to tell what is reachable, behind one interface: reachable (node) and the call graph (site, callee, kind).

A strategy is a function of no argument, made from its inputs, so triage need not know which one it runs.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from . import andersen, reachability, two_phase
from .fixpoint import reach


class Reached(NamedTuple):
    reachable: DataFrame
    callgraph: DataFrame


Strategy = Callable[[], Reached]
UNKNOWN = "Unknown"  # the kind of a call whose table has none


def simple(facts: dict[str, DataFrame]) -> Strategy:
    """The default analysis; facts as reachability.analysis takes them."""

    def run() -> Reached:
        found = reachability.analysis(facts)
        return Reached(found["reachable"], found["callgraph"])

    return run


def summaries(edges: DataFrame, side: dict[str, DataFrame], enclosing: DataFrame, seeds: DataFrame) -> Strategy:
    """The two-phase analysis; inputs as two_phase.analysis takes them."""

    def run() -> Reached:
        found = two_phase.analysis(edges, side, enclosing, seeds)
        return Reached(found["reachable"], found["callgraph"].withColumn("kind", F.lit(UNKNOWN)))

    return run


def pointers(facts: dict[str, DataFrame], enclosing: DataFrame, seeds: DataFrame) -> Strategy:
    """Inclusion-based points-to. facts: andersen.points_to's tables by name; enclosing: fn, local; seeds: node."""

    def run() -> Reached:
        spark = seeds.sparkSession
        pts = andersen.points_to(spark, **facts)
        functions = facts["funcs"].select(F.col("node").alias("callee"))
        met = facts["calls"].join(pts.select(F.col("node").alias("callee"), "obj"), "callee").select("site", F.col("obj").alias("callee"), (F.col("callee") == F.col("obj")).alias("direct"))
        calls = met.join(functions, "callee", "left_semi").select("site", "callee", F.when(F.col("direct"), "Direct").otherwise("Indirect").alias("kind")).distinct()
        calls = written(calls, "calls")
        steps = calls.join(enclosing.select(F.col("local").alias("site"), "fn"), "site").select(F.col("fn").alias("src"), F.col("callee").alias("dst"))
        return Reached(reach(seeds, steps), calls)

    return run


def address(text: Column) -> Column:
    """The number of a function's address in hexadecimal; null for locals and for what is no such number."""
    form = F.regexp_extract(F.trim(text), "^(?:0x)?([0-9a-fA-F]{1,16})$", 1)
    return F.when(form != "", F.conv(form, 16, 10).cast("decimal(20,0)"))


def saved(spark: SparkSession, reachable: str, callgraph: str) -> Strategy:
    """What an earlier run left: lines of addresses, and lines of site, callee and, if there, kind. Lines of reachable that are no addresses are left out."""

    def run() -> Reached:
        found = spark.read.text(reachable).select(address(F.col("value")).alias("node")).where("node IS NOT NULL").distinct()
        parts = F.split("value", "\t")
        lines = spark.read.text(callgraph).where(F.size(parts) >= 2)
        calls = lines.select(F.trim(parts[0]).alias("site"), F.trim(parts[1]).alias("callee"), F.coalesce(F.trim(F.try_element_at(parts, F.lit(3))), F.lit(UNKNOWN)).alias("kind"))
        return Reached(found, calls)

    return run


def save(found: Reached, reachable: str, callgraph: str) -> None:
    """Writes what saved() reads."""
    found.reachable.select(F.col("node").cast("string").alias("value")).write.text(reachable)
    found.callgraph.select(F.concat_ws("\t", F.col("site").cast("string"), F.col("callee").cast("string"), "kind").alias("value")).write.text(callgraph)
