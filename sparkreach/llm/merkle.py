"""Merkle manifest of a dataset: a tree a source, a tree over the sources, and a proof for each row, folded in its block.

A leaf is the digest of a row's fields. Within a source leaves ascend by doc_id and runs of FAN nodes become one until
one is left; the sources' subroots make the root in the same way. Nothing follows a whole source: leaves are sorted over
the cluster and numbered by counts of the sorted partitions, and a superblock of FAN ** LEVELS neighbours is reduced to
one node by itself, whole levels at a time. The superblocks' nodes are the leaves of the next tier, so there are about
as many tiers as the logarithm of the largest source to the base 729. On the way down each tier's nodes are cogrouped by
superblock with the outer nodes that their proofs need (the siblings above the superblock, a few for each level), which
become the outer nodes of the superblocks below. At the leaves the same cogroup reduces the block again, joins the inner
and outer siblings of each leaf and folds the leaf as received up to the root.

Tiers are written tables; a task holds one superblock of 729 digests, whichever source they are of, and executors may be
lost at any time.

Cases: a null field is `-`; a null source is a source of its own, before all others; rows with equal ids follow each
other by digest, so equal rows have equal leaves and neighbouring places; rows without an id come first in their source
and are never tampered with; a single row is its source's subroot and, alone, the root; an empty table gives no rows;
texts are hashed whole, at any length; ids may be of any ordered type; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, written

FAN, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tiers(nodes: list[str], total: int, levels: int) -> list[list[str]]:
    """Levels of a superblock's tree from its nodes up to one: all of them, or as many as a sequence of only one superblock has."""
    out = [nodes]
    while len(out[-1]) > 1 or (total > FAN**levels and len(out) <= levels):
        last = out[-1]
        out.append([h("".join(last[i : i + FAN])) for i in range(0, len(last), FAN)])
    return out


def siblings(levels: list[list[str]], place: int) -> tuple[list[str], list[str]]:
    """The siblings to the left and to the right of the node at place, a string a level."""
    left, right = [], []
    for nodes in levels[:-1]:
        start = place - place % FAN
        left.append("".join(nodes[start:place]))
        right.append("".join(nodes[place + 1 : start + FAN]))
        place //= FAN
    return left, right


def folded(leaf: str, left: list[str], right: list[str]) -> str:
    for a, b in zip(left, right, strict=True):
        leaf = h(a + leaf + b)
    return leaf


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, received: Column) -> DataFrame:
    """doc_id, tree (the source as a key), leaf, received (the leaf with `received` as the text, null where it is the same)."""
    digest = lambda text: F.sha2(F.concat(*(field(F.col(c)) for c in FIELDS[:-1]), field(text)), 256)
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select("doc_id", tree.alias("tree"), digest(F.col("text")).alias("leaf"), F.when(received != F.col("text"), digest(received)).alias("received"))


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df, sorted by tree and order, with place (from 0) and total within tree, written."""
    at = written(df.orderBy("tree", *order).withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("at", 33)
    parts = at.groupBy("tree", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")  # of at most one row a partition
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    starts = written(parts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("total")), f"{name}_starts")
    placed = at.withColumn("part", part).join(starts, ["tree", "part"])
    return placed.select(*df.columns, (F.col("at") + F.col("shift")).alias("place"), "total")


def blocked(nodes: DataFrame, levels: int) -> DataFrame:
    size = FAN**levels
    return nodes.withColumn("block", F.expr(f"place div {size}")).withColumn("place", F.col("place") % size)


def top(pdf: pd.DataFrame, levels: int) -> pd.DataFrame:
    """A superblock's node in the next tier."""
    pdf = pdf.sort_values("place")
    total = int(pdf["total"].iloc[0])
    return pd.DataFrame({"tree": pdf["tree"].iloc[:1].tolist(), "place": pdf["block"].iloc[:1].tolist(), "node": tiers(pdf["node"].tolist(), total, levels)[-1], "total": -(-total // FAN**levels)})


def climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Tiers of tree, place, node, total: the given one, then each made of the superblocks of the one before, while trees have more than one node."""
    out = [nodes]
    while not (rest := out[-1].where("total > 1")).isEmpty():
        out.append(written(blocked(rest, levels).groupBy("tree", "block").applyInPandas(lambda pdf: top(pdf, levels), "tree string, place bigint, node string, total bigint"), "tier"))
    return out


def apex(made: list[DataFrame]) -> DataFrame:
    """tree, node: the top of each tree."""
    one = [t.where("total = 1").select("tree", "node") for t in made]
    out = one[0]
    for t in one[1:]:
        out = out.unionByName(t)
    return out


def paths(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int) -> tuple[pd.DataFrame, list[list[str]], list[list[str]]]:
    """A superblock's nodes in order, and the siblings of each from its own level to the root."""
    nodes = nodes.sort_values("place")
    up = tiers(nodes["node"].tolist(), int(nodes["total"].iloc[0]), levels)
    inner = [siblings(up, i) for i in range(len(nodes))]
    left, right = list(outer["left"].iloc[0]), list(outer["right"].iloc[0])
    return nodes, [a + left for a, _ in inner], [b + right for _, b in inner]


OUTER = "`left` array<string>, `right` array<string>, subroot string, root string"


def lower(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    """The outer nodes of the superblocks below."""
    nodes, left, right = paths(nodes, outer, levels)
    return pd.DataFrame({"tree": nodes["tree"], "block": nodes["block"] * FAN**levels + nodes["place"], "left": left, "right": right, "subroot": outer["subroot"].iloc[0], "root": outer["root"].iloc[0]})


def named(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    """The outer nodes of the trees whose tops are nodes."""
    nodes, left, right = paths(nodes, outer, levels)
    return pd.DataFrame({"tree": nodes["name"], "left": left, "right": right, "subroot": nodes["node"], "root": outer["root"].iloc[0]})


def proved(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    """Leaves with their proofs, and the root that each leaf as received folds to."""
    nodes, left, right = paths(nodes, outer, levels)
    received = nodes["received"].where(nodes["received"].notna(), nodes["node"])
    ends = [folded(x, a, b) for x, a, b in zip(received, left, right, strict=True)]
    return pd.DataFrame({"doc_id": nodes["doc_id"], "leaf": nodes["node"], "subroot": outer["subroot"].iloc[0], "root": outer["root"].iloc[0], "left": left, "right": right, "folded_root": ends})


def exchanged(nodes: DataFrame, outer: DataFrame, f: Callable, schema: str, levels: int) -> DataFrame:
    """f of each superblock's nodes and the outer nodes that it requires."""
    some = blocked(nodes, levels).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    return some.applyInPandas(lambda own, above: f(own, above, levels), schema)


def descend(made: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """tree, block and what tops (tree, left, right, subroot, root of whole trees) has, for each superblock of the lowest tier, written."""
    below = None
    for j in reversed(range(len(made))):
        whole = made[j].where(f"place = 0 AND total <= {FAN**levels}" + " AND total > 1" * (j > 0)).select("tree", F.lit(0).cast("bigint").alias("block")).join(tops, "tree")
        below = written(whole if below is None else whole.unionByName(below), "outer")
        if j:
            below = exchanged(made[j].where("total > 1"), below, lower, f"tree string, block bigint, {OUTER}", levels)
    return below


def prove(docs: DataFrame, received: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, left, right, folded_root for each row of docs, written.

    left, right: the siblings on either side, a string a level from the leaf's to the root's. folded_root: what the leaf
    of the row with `received` as its text folds to. levels: of a superblock, FAN ** levels nodes wide.
    """
    with scratch(docs.sparkSession):
        own = written(leaves(docs, F.col("text") if received is None else received), "leaves")
        own = written(numbered(own, "sorted", "doc_id", "leaf").withColumnRenamed("leaf", "node"), "placed")
        made = climb(own.select("tree", "place", "node", "total"), levels)
        sources = written(apex(made).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), "subroots")
        sources = written(numbered(sources, "sources", "name"), "placed")
        upper = climb(sources.select("tree", "place", "node", "total"), levels)
        none = F.array().cast("array<string>")
        root = apex(upper).select("tree", none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
        tops = written(exchanged(sources, descend(upper, root, levels), named, f"tree string, {OUTER}", levels), "tops")
        kind = docs.schema["doc_id"].dataType.simpleString()
        text = own.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas has no whole numbers with nulls
        schema = "doc_id string, leaf string, subroot string, root string, `left` array<string>, `right` array<string>, folded_root string"
        found = exchanged(text, descend(made, tops, levels), proved, schema, levels)
        return written(found.withColumn("doc_id", F.col("doc_id").cast(kind)), "proofs", lasting=True)


def tampered() -> Column:
    """The text without its newlines where 2 divides the checksum of doc_id."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))


def report(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    proof = F.sha2(F.array_join(F.zip_with("left", "right", lambda a, b: F.concat(a, b)), ""), 256)
    return prove(docs, tampered(), levels).select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
