"""Operators over fact tables: visits, projections, aggregates and checks of the analysis's inputs.

edges: rel, fn (the enclosing function), dst, src, idx.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nodes import starred

RELATIONS = ("Assign", "Load", "Store", "Call", "Return", "ArgumentDefinition", "ArgumentSupply", "Dlsym")
# fixed values: which ends each relation reads and writes
READS = {"Assign": ("src",), "Load": ("src",), "Store": ("dst", "src"), "Call": ("src",), "Return": ("src",), "ArgumentDefinition": (), "ArgumentSupply": ("src",), "Dlsym": ()}
WRITES = {"Assign": ("dst",), "Load": ("dst",), "Store": (), "Call": ("dst",), "Return": (), "ArgumentDefinition": ("dst",), "ArgumentSupply": (), "Dlsym": ("dst",)}


def visit(edges: DataFrame, *relations: str) -> DataFrame:
    return edges.where(F.col("rel").isin(*(relations or RELATIONS)))


def _ends(table: dict[str, tuple]) -> Column:
    out = F.lit(None)
    for rel, ends in table.items():
        out = F.when(F.col("rel") == rel, F.array(*(F.col(e) for e in ends)) if ends else F.array().cast("array<bigint>")).otherwise(out)
    return out


def reads(edges: DataFrame) -> DataFrame:
    """rel, node, one row for each end that is read."""
    return edges.select("rel", F.explode(_ends(READS)).alias("node"))


def writes(edges: DataFrame) -> DataFrame:
    return edges.select("rel", F.explode(_ends(WRITES)).alias("node"))


def star_chain(nodes: DataFrame, most: int = 3) -> DataFrame:
    """starred, node: each level over the one below, and the last over itself."""
    at = F.explode(F.sequence(F.lit(1), F.lit(most + 1))).alias("i")
    rows = nodes.select("node", at)
    level = lambda i: F.when(i == 0, F.col("node")).otherwise(starred(F.col("node"), i, most))
    return rows.select(F.when(F.col("i") <= most, level(F.col("i"))).otherwise(level(F.lit(most))).alias("starred"), level(F.col("i") - 1).alias("node"))


def value_names(nodes: DataFrame, most: int = 3) -> DataFrame:
    """core, value: a node and its starred forms."""
    rows = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("i"))
    return rows.select(F.col("node").alias("core"), F.when(F.col("i") == 0, F.col("node")).otherwise(starred(F.col("node"), F.col("i"), most)).alias("value"))


def arity(functions: DataFrame, params: DataFrame) -> DataFrame:
    """fn, nargs: the largest argument number and one, 0 without arguments."""
    most = params.groupBy("fn").agg((F.max("arg_no") + 1).alias("nargs"))
    return functions.join(most, "fn", "left").select("fn", F.coalesce("nargs", F.lit(0)).cast("bigint").alias("nargs"))


def arity_conflicts(calls: DataFrame) -> DataFrame:
    """fn, low, high of functions called with different numbers of arguments. calls: fn, nargs."""
    return calls.groupBy("fn").agg(F.min("nargs").alias("low"), F.max("nargs").alias("high")).where("low <> high")


def node_state(uses: DataFrame) -> DataFrame:
    """node, state of uses (node, state): undefined gives way to data or a function; both at once is a conflict."""
    both = uses.groupBy("node").agg(F.max((F.col("state") == "data").cast("int")).alias("d"), F.max((F.col("state") == "function").cast("int")).alias("f"))
    return both.select("node", F.when(F.col("d") + F.col("f") == 2, "conflict").when(F.col("f") == 1, "function").when(F.col("d") == 1, "data").otherwise("undefined").alias("state"))


def undefined(referenced: DataFrame, defined: DataFrame, overridden: DataFrame) -> DataFrame:
    """node: referenced, but neither defined nor modelled."""
    return referenced.select("node").distinct().join(defined.select("node"), "node", "left_anti").join(overridden.select("node"), "node", "left_anti")


def argument_lists(supply: DataFrame) -> DataFrame:
    """site, arg_no, values (sorted, repeated ones kept)."""
    return supply.groupBy("site", "arg_no").agg(F.sort_array(F.collect_list("value")).alias("values"))


def multimap(edges: DataFrame) -> DataFrame:
    """node, parents, children (sorted sets)."""
    down = edges.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_set("src")).alias("parents"))
    up = edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("children"))
    none = F.array().cast(edges.schema["src"].dataType.simpleString().join(("array<", ">")))
    return down.join(up, "node", "full").select("node", F.coalesce("parents", none).alias("parents"), F.coalesce("children", none).alias("children"))


def checked(rows: DataFrame, problem: Column, message: str) -> DataFrame:
    """rows; reading one for which problem holds is an error."""
    return rows.where(F.when(problem, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))


def segment_hash(segments: DataFrame) -> DataFrame:
    """digest of a set of segments (lo, hi), whatever their order: a sum of row hashes, so partial sums combine."""
    row = F.xxhash64("lo", "hi")
    return segments.select("lo", "hi").distinct().groupBy().agg(F.sum(row.cast("decimal(38,0)")).cast("string").alias("digest"), F.count("*").alias("n"))


def differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """side (first or second) and the rows that only it has; none if both are the same set. Nulls equal nulls."""
    one, two = first.withColumn("side", F.lit("first")), second.select(*first.columns).withColumn("side", F.lit("second"))
    held = one.unionByName(two).groupBy(*first.columns).agg(F.min("side").alias("side"), F.max("side").alias("_last"))
    return held.where("side = _last").drop("_last")
