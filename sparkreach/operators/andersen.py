"""Inclusion-based points-to analysis (field-, context- and flow-insensitive) as a fixpoint over tables.

Facts: alloc (node, obj), assign, load and store (dst, src), funcs (node), calls (site, callee), supply (site, arg_no,
value), params (fn, arg_no, value), returns (fn, value), dlsym (dst, obj). A function points to itself. Loads, stores
and calls through pointers add copy edges as points-to sets grow; each round joins only new points-to rows and new
copy edges with what is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .fixpoint import union
from .ordered import asof


def pairs(spark, kind: str) -> DataFrame:
    return spark.createDataFrame([], f"dst {kind}, src {kind}")


def copies_of(new: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """dst, src: copy edges that new points-to rows (node, obj) add."""
    load, store, calls = facts["load"], facts["store"], facts["calls"]
    through = new.join(load, new["node"] == load["src"]).select(load["dst"], F.col("obj").alias("src"))
    into = new.join(store, new["node"] == store["dst"]).select(F.col("obj").alias("dst"), store["src"])
    found = [through, into]
    if not facts["empty_calls"]:
        called = new.join(calls, new["node"] == calls["callee"]).select("site", F.col("obj").alias("fn")).distinct()
        supply, params, returns = facts["supply"], facts["params"], facts["returns"]
        given = called.join(supply, "site").select("fn", "arg_no", F.col("value").alias("src")).join(params.select("fn", "arg_no", F.col("value").alias("dst")), ["fn", "arg_no"])
        found += [given.select("dst", "src"), called.join(returns, "fn").select(F.col("site").alias("dst"), F.col("value").alias("src"))]
    return union(found).distinct()


def points_to(spark, alloc, assign, load, store, funcs=None, calls=None, supply=None, params=None, returns=None, dlsym=None) -> DataFrame:
    """node, obj."""
    kind = alloc.schema["node"].dataType.simpleString()
    base = [alloc.select("node", "obj")]
    if funcs is not None:
        base.append(funcs.select("node", F.col("node").alias("obj")))
    if dlsym is not None:
        base.append(dlsym.where("obj IS NOT NULL").select(F.col("dst").alias("node"), "obj"))
    none = lambda s: spark.createDataFrame([], s)
    facts = {
        "load": load,
        "store": store,
        "calls": calls if calls is not None else none(f"site {kind}, callee {kind}"),
        "supply": supply if supply is not None else none(f"site {kind}, arg_no bigint, value {kind}"),
        "params": params if params is not None else none(f"fn {kind}, arg_no bigint, value {kind}"),
        "returns": returns if returns is not None else none(f"fn {kind}, value {kind}"),
        "empty_calls": calls is None,
    }
    new = written(union(base).distinct(), "pts")
    copy = written(assign.select("dst", "src").distinct(), "copies")
    known, edges, new_edges = [new], [copy], copy
    while True:
        every, all_edges = union(known), union(edges)
        added = written(copies_of(new, facts).join(all_edges, ["dst", "src"], "left_anti"), "copies")
        edges.append(added)
        fresh = new_edges.unionByName(added)
        # new rows over all edges, all rows over new edges
        moved = new.join(union(edges), F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "obj").unionByName(every.join(fresh, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "obj"))
        new = written(moved.distinct().join(every, ["node", "obj"], "left_anti"), "pts")
        new_edges = added
        if new.isEmpty():
            return every
        known.append(new)
        if len(known) > 12:
            known, edges = [written(union(known), "pts")], [written(union(edges).distinct(), "copies")]


def conservative(args: DataFrame) -> DataFrame:
    """dst, src: all arguments of a call (site, value) flow into one another through one place of the call's own."""
    mix = F.concat(F.lit("mix:"), F.col("site").cast("string"))
    return args.select(mix.alias("dst"), F.col("value").cast("string").alias("src")).unionByName(args.select(F.col("value").cast("string").alias("dst"), mix.alias("src")))


def missing_edges(observed: DataFrame, static: DataFrame) -> DataFrame:
    """Observed rows that the analysis does not have."""
    return observed.join(static, observed.columns, "left_anti").distinct()


def observed_edges(traced: DataFrame, sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """node, value: traced (site, value) edges as nodes. sites: addr, node; symbols: start.

    A value that is a site's address is that site's node, any other the start of the symbol at or before it; a value
    below all symbols is dropped. A traced site that is not known is an error.
    """
    known = traced.join(sites.select(F.col("addr").alias("site"), "node"), "site", "left")
    lost = F.raise_error(F.concat(F.lit("no trace site at "), F.col("site").cast("string"))).cast(sites.schema["node"].dataType)
    known = known.select(F.coalesce("node", lost).alias("node"), "value").distinct()
    kind = sites.schema["node"].dataType
    at_site = known.join(sites.select(F.col("addr").alias("value"), F.col("node").alias("_other")), "value", "left")
    placed = asof(at_site, "value", symbols.select(F.col("start").alias("_start")).distinct(), "_start")
    return placed.select("node", F.coalesce("_other", F.col("_start").cast(kind)).alias("value")).where("value IS NOT NULL").distinct()
