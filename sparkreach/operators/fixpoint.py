"""Fixpoints: semi-naive loops whose rounds are written tables.

A round joins what was new with the edges and keeps what is not known yet. The known rows are the written tables of all
rounds, read as one. Plans stay small and executors may be lost. Of few new rows (`FEW`, counted) a round makes several
hops, which share one exchange of the edges, so long thin paths take a round for `hops` steps; of more it makes one,
since inner hops pass over known rows again.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import counted, written

HOPS = 8
FEW = 100_000


def union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def fixpoint(base: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], hops: int = 1, carries: bool = False) -> DataFrame:
    """base with all that step(new rows, all rows) adds, as a set. carries: step gives its new rows back among the others, so that a plan of several hops stays linear."""
    new, n = counted(base.distinct(), "round")
    known = [new]
    while n:
        every, some, got = union(known), new, []
        for _ in range(hops if n <= FEW else 1):
            some = step(some, every).select(*base.columns).distinct()
            got.append(some)
        some, old = (some if carries else union(got).distinct()).alias("s"), every.alias("o")
        same = functools.reduce(lambda x, y: x & y, (F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}")) for c in base.columns))
        new, n = counted(some.join(old, same, "left_anti"), "round")
        known.append(new)
        if len(known) > 16:  # few files to read, whatever the depth
            known = [written(union(known), "round")]
    return union(known)


def reach(seeds: DataFrame, edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """node: the seeds and what they reach. seeds: node (a null one is none); edges: src, dst."""
    edges = written(edges.select("src", "dst").distinct(), "edges")
    onward = lambda new, _: new.join(edges, new["node"] == edges["src"], "left").select(F.explode(F.array("node", F.coalesce("dst", "node"))).alias("node"))
    return fixpoint(seeds.select("node").where("node IS NOT NULL"), onward, hops, carries=True)


def closure(edges: DataFrame) -> DataFrame:
    """src, dst: the transitive closure, by joining what is new with the edges (linear; as good as the rule that joins it with itself)."""
    edges = written(edges.select("src", "dst").distinct(), "edges")
    right = edges.select(F.col("src").alias("mid"), F.col("dst").alias("far"))
    return fixpoint(edges, lambda new, _: new.join(right, new["dst"] == right["mid"]).select("src", F.col("far").alias("dst")))


def cheapest(seeds: DataFrame, edges: DataFrame, hops: int = HOPS, by: Sequence[str] = ()) -> DataFrame:
    """by, node, cost, prev: least cost from the seeds (by, node, cost), for each key by itself in one search. edges: src, dst, weight (0 or more). Of equal costs the smallest predecessor."""
    at = [*by, "node"]
    edges = written(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "edges")
    new, n = counted(seeds.groupBy(*at).agg(F.min("cost").cast("bigint").alias("cost")), "costs")
    known = [new]
    least = lambda: union(known).groupBy(*at).agg(F.min("cost").alias("cost"))
    while n:
        some = new
        for _ in range(hops if n <= FEW else 1):
            both = some.join(edges, some["node"] == edges["src"], "left")
            here = F.struct(*at, "cost")
            there = F.struct(*by, F.coalesce("dst", "node").alias("node"), (F.col("cost") + F.coalesce("weight", F.lit(0))).cast("bigint").alias("cost"))
            some = both.select(F.inline(F.array(here, there))).groupBy(*at).agg(F.min("cost").alias("cost"))
        best = some.select(*at, F.col("cost").alias("lower"))
        new, n = counted(best.join(least(), at, "left").where("cost IS NULL OR lower < cost").select(*at, F.col("lower").alias("cost")), "costs")
        known.append(new)
        if len(known) > 16:
            known = [written(least(), "costs")]
    known = written(least(), "costs")
    before = known.select(*by, F.col("node").alias("src"), F.col("cost").alias("before"))
    back = known.join(edges, known["node"] == edges["dst"]).join(before, [*by, "src"]).where("before + weight = cost").groupBy(*at).agg(F.min("src").alias("prev"))
    start = seeds.groupBy(*at).agg(F.min("cost").alias("seed"))
    found = known.join(back, at, "left").join(start, at, "left")
    return found.select(*at, "cost", F.when(F.col("seed") == F.col("cost"), None).otherwise(F.col("prev")).alias("prev"))
