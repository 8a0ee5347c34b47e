"""The two-phase analysis: facts of each function are summarised on their own, then solved for the whole program.

edges: rel, fn, dst, src, idx. `sub` (x, y): y may stand where x does. Both phases are fixpoints over tables; in phase one
the function is part of every key, so all functions are summarised in one distributed loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .fixpoint import fixpoint, reach, union


def values(edges: DataFrame, by: list[str]) -> DataFrame:
    return edges.select(*by, F.explode(F.array("dst", "src")).alias("v")).where("v IS NOT NULL").distinct()


def substitutions(edges: DataFrame, by: list[str], stars: DataFrame | None = None, congruent: bool = False) -> DataFrame:
    """by, x, y: the least relation that is reflexive and transitive, holds assignments, returns and arguments of known
    calls, and what is loaded from where it was stored.

    stars: starred, node (what node points to). What is stored where node may point stands for its starred form, and the
    starred form for what is loaded from there; congruent (phase two): starred forms of substitutes are substitutes.
    """
    of = lambda rel: edges.where(F.col("rel") == rel)
    assign = of("Assign").select(*by, F.col("dst").alias("x"), F.col("src").alias("y"))
    call, ret = of("Call").select(*by, F.col("dst").alias("site"), F.col("src").alias("f")), of("Return").select(F.col("dst").alias("f"), F.col("src").alias("y"))
    returned = call.join(ret, "f").select(*by, F.col("site").alias("x"), "y")
    defs = of("ArgumentDefinition").select(F.col("src").alias("f"), F.col("dst").alias("x"), "idx")
    given = of("ArgumentSupply").select(*by, F.col("dst").alias("site"), F.col("src").alias("y"), "idx")
    passed = call.join(given, [*by, "site"]).join(defs, ["f", "idx"]).select(*by, "x", "y")
    v = values(edges, by)
    if stars is not None:
        stars = written(stars.select("starred", "node").distinct(), "stars")
        ends = stars.select(F.explode(F.array("starred", "node")).alias("v"), "starred", "node")
        v = fixpoint(v, lambda new, _: new.join(ends, "v").select(*by, F.explode(F.array("starred", "node")).alias("v")))
    base = union([v.select(*by, F.col("v").alias("x"), F.col("v").alias("y")), assign, returned, passed]).distinct()
    load, store = of("Load").select(*by, F.col("dst").alias("into"), F.col("src").alias("p")), of("Store").select(*by, F.col("dst").alias("q"), F.col("src").alias("val"))

    def step(new: DataFrame, every: DataFrame) -> DataFrame:
        far = every.select(*by, F.col("x").alias("y"), F.col("y").alias("z"))
        near = every.select(*by, F.col("y").alias("x"), F.col("x").alias("w"))
        onward = new.join(far, [*by, "y"]).select(*by, "x", F.col("z").alias("y"))
        before = new.join(near, [*by, "x"]).select(*by, F.col("w").alias("x"), "y")
        # pointers that may be the same place: a common substitute
        ends = new.select(*by, F.col("x").alias("p"), F.col("y").alias("at"))
        other = every.select(*by, F.col("x").alias("q"), F.col("y").alias("at"))
        seen = load.join(ends, [*by, "p"]).join(other.join(store, [*by, "q"]), [*by, "at"]).select(*by, F.col("into").alias("x"), F.col("val").alias("y"))
        ends2, other2 = new.select(*by, F.col("x").alias("q"), F.col("y").alias("at")), every.select(*by, F.col("x").alias("p"), F.col("y").alias("at"))
        seen2 = store.join(ends2, [*by, "q"]).join(other2.join(load, [*by, "p"]), [*by, "at"]).select(*by, F.col("into").alias("x"), F.col("val").alias("y"))
        out = [onward, before, seen, seen2]
        if stars is not None:
            under, over = stars.select(F.col("node").alias("x"), F.col("starred").alias("sx")), stars.select(F.col("node").alias("y"), F.col("starred").alias("sy"))
            out.append(store.join(new.select(*by, F.col("x").alias("q"), "y"), [*by, "q"]).join(over, "y").select(*by, F.col("sy").alias("x"), F.col("val").alias("y")))
            out.append(load.join(new.select(*by, F.col("x").alias("p"), "y"), [*by, "p"]).join(over, "y").select(*by, F.col("into").alias("x"), F.col("sy").alias("y")))
            if congruent:
                out.append(new.join(under, "x").join(over, "y").select(*by, F.col("sx").alias("x"), F.col("sy").alias("y")))
        return union(out)

    return fixpoint(base, step)


def precious(edges: DataFrame, symbols: DataFrame, allocas: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """v: what the rest of the program can see: symbols, arguments, call sites and supplied allocations, and, level by level, the value names (core, value) of those."""
    given = edges.where("rel = 'ArgumentSupply'").select(F.col("src").alias("v")).join(allocas.select(F.col("node").alias("v")), "v", "left_semi")
    seen = union([symbols.select(F.col("node").alias("v")), edges.where("rel = 'ArgumentDefinition'").select(F.col("dst").alias("v")), edges.where("rel IN ('Call', 'ArgumentSupply')").select(F.col("dst").alias("v")), given]).where("v IS NOT NULL").distinct()
    if names is None:
        return seen
    return fixpoint(seen, lambda new, _: new.join(names.select(F.col("core").alias("v"), "value"), "v").select(F.col("value").alias("v")))


def precious_facts(kept: DataFrame, stars: DataFrame, names: DataFrame, allocas: DataFrame) -> DataFrame:
    """rel, a, b: what phase two needs to know of precious values: starred forms, value names and which are allocations."""
    of = lambda rows, rel, a, b: rows.join(kept.select(F.col("v").alias(a)), a, "left_semi").select(F.lit(rel).alias("rel"), F.col(a).alias("a"), b.alias("b"))
    return union([of(stars, "Starred", "starred", F.col("node")), of(names, "ValueName", "core", F.col("value")), of(allocas, "IsAlloca", "node", F.lit(None).cast("bigint"))]).distinct()


def summarise(edges: DataFrame, symbols: DataFrame, allocas: DataFrame) -> DataFrame:
    """Phase one: each function's edges over precious values, its inner values substituted away."""
    sub = written(substitutions(edges.where("rel NOT IN ('Return') OR dst IS NOT NULL"), ["fn"]), "sub")
    kept = written(precious(edges, symbols, allocas), "precious")
    x = sub.select("fn", F.col("x").alias("dst"), F.col("y").alias("_d"))
    y = sub.select("fn", F.col("x").alias("src"), F.col("y").alias("_s"))
    out = edges.join(x, ["fn", "dst"]).join(y, ["fn", "src"]).select("rel", "fn", F.when(F.col("rel").isin("Store", "Load"), F.col("_d")).otherwise(F.col("dst")).alias("dst"), F.col("_s").alias("src"), "idx")
    whole = edges.unionByName(out).distinct()
    inner = whole.where("rel IN ('Load', 'Store')")
    outer = whole.where("rel NOT IN ('Load', 'Store')").join(kept.select(F.col("v").alias("dst")), "dst", "left_semi").join(kept.select(F.col("v").alias("src")), "src", "left_semi")
    return outer.select("rel", "fn", "dst", "src", "idx").unionByName(inner.select("rel", "fn", "dst", "src", "idx")).distinct()


def solve(edges: DataFrame, symbols: DataFrame, enclosing: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Phase two: (site, callee) calls with substitutes, (node) reachable functions."""
    sub = written(substitutions(edges.withColumn("all", F.lit(0)), ["all"]).select("x", "y"), "sub")
    calls = edges.where("rel = 'Call'").select(F.col("dst").alias("site"), F.col("src").alias("x")).join(sub, "x").select("site", F.col("y").alias("callee"))
    calls = written(calls.join(symbols.select(F.col("node").alias("callee")), "callee", "left_semi").select("site", "callee").distinct(), "calls")
    by_function = calls.join(enclosing.select(F.col("local").alias("site"), "fn"), "site").select(F.col("fn").alias("src"), F.col("callee").alias("dst"))
    return calls, reach(seeds.select("node"), by_function)
