"""N-gram Jaccard join with token-combination prefixes, up to connected components.

A document's tokens are its distinct four-word shingles, in one order for all: rarer first (by document frequency,
counted over all documents), then by hash. For similarity s, sets of sizes n that overlap in at least ceil(s n) tokens
share k tokens among their first n - ceil(s n) + k. Tokens of at most `FREQUENT` documents are indexed alone, in the
prefix for k = 2; of more frequent ones all pairs of them are, so that a passage common to many documents makes no
bucket by a single token. Pairs are for documents of at most `SMALL` tokens (some hundred pairs at most); larger ones,
and those close enough in size to be similar to one, have the frequent tokens of their k = 1 prefix alone. Either way
any two similar documents share a key. Tokens of one document only are in no index.

Equal sets are told apart first by a digest, and one document stands for them. Shared keys are not turned into pairs.
Each of ROUNDS rounds takes the LEADS smallest keys of a document and one document, the centre, of each such key; a
document is verified against CENTRES centres of other components that it shares most of these keys with, and links
merge components. The rounds only make components large early. What then still shares any key, of all of them, across
components forms clusters; in each, documents outside the largest component are held against all of other components,
so no link between components is lost. A
cluster is dealt out by size class (similar sets are of the same or neighbouring classes) and within one as a grid of
cells of at most some CELL documents a side, however large it is; a cell counts overlaps through an inverted index.

Frequencies move as packed keys by block and bucket (see blocks.py); tables of candidates are written.

Cases: null and blank texts have no shingles and are linked with nothing; fewer than four words are one shingle; equal
texts are of one component; rows are told apart where their ids are equal; a null doc_id never names a component that
has another. Ids may be of any ordered type. Texts of any length are taken whole (one over 2 MB is a block of its own);
an empty table gives no rows; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .blocks import MOST, alike, copies, count_keys, expand, members, pack, with_answers
from .common import scratch, unveiled, veiled, written

SHINGLE, PERCENT = 4, 85
FREQUENT, SMALL = 32, 200
ROUNDS, CENTRES, LEADS = 3, 2, 8
WORTH = 20  # a round that links fewer than one pair of so many is the last
CELL = 128
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
REMEMBERED = 1 << 17


class Known(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


KNOWN = Known()


def numbers(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, remembered (a bounded number of them) in the process, which outlives its tasks."""
    if len(KNOWN) > REMEMBERED:
        KNOWN.clear()
    return np.fromiter(map(KNOWN.__getitem__, words), np.uint64, len(words))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers; np.unique hashes before it sorts, which takes many times as long."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of size-word shingles; the whole sequence as one if there are fewer words."""
    words = text.lower().split()  # of bytes: A-Z only, and blanks are \\x20 and \\x09-\\x0D
    if not words:
        return np.zeros(0, np.uint64)
    w = numbers(words)
    size = min(size, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = (h ^ w[i : len(w) - size + 1 + i]) * A
        h ^= h >> np.uint64(29)
    return distinct(h)


def texts(row: dict):
    data, at = expand(row["data"]), 0
    for n in row["lengths"]:
        yield data[at : at + n]
        at += n


def describe(text: bytes) -> tuple[str | None, int]:
    s = shingles(text)
    return (xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None), len(s)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def keys(order: np.ndarray, df: np.ndarray, own: int) -> list[int]:
    """Index keys of a set given in the common order. own: in how many documents a token is that only copies have."""
    n = len(order)
    if n < 2:  # only an equal set is similar
        return []
    least = least_overlap(n)
    longer = slice(0, min(n, n - least + 2))
    shared = df[longer] > own if own <= MOST else np.ones(len(df[longer]), bool)
    rare = df[longer] <= FREQUENT
    found = [order[longer][shared & rare]]
    often = order[longer][shared & ~rare]
    if n <= SMALL:
        i, j = np.triu_indices(len(often), 1)
        found.append((often[i] * B ^ often[j]) * A)
    if n >= least_overlap(SMALL):
        shorter = slice(0, n - least + 1)
        s = df[shorter] > own if own <= MOST else np.ones(len(df[shorter]), bool)
        found.append(order[shorter][s & (df[shorter] > FREQUENT)])
    return distinct(np.concatenate(found)).view(np.int64).tolist()


def candidates(row: dict, counts: np.ndarray, copied: dict[int, int]) -> dict[str, list]:
    """rid, doc_id, mark, n, keys and shingles of the block's documents that share a key's token with another."""
    sets = [shingles(t) for t in texts(row)]
    out: dict[str, list] = {n: [] for n in ("rid", "doc_id", "mark", "n", "keys", "shingles")}
    if not any(map(len, sets)):
        return out
    flat = np.concatenate(sets)
    by = np.argsort(flat)
    ranked, every = flat[by], np.empty(len(flat), np.uint8)
    every[by] = counts[np.cumsum(np.concatenate(([False], ranked[1:] != ranked[:-1])))]
    ends = np.cumsum([len(s) for s in sets])
    for i, s in enumerate(sets):
        own = copied.get(i, 1)
        if not own or not len(s):
            continue
        df = every[ends[i] - len(s) : ends[i]]
        order = np.argsort(df, kind="stable")  # ties by hash, as sets are sorted
        found = keys(s[order], df[order], own)
        if found:
            for name, v in (("rid", row["rids"][i]), ("doc_id", row["doc_ids"][i]), ("mark", row["marks"][i]), ("n", len(s)), ("keys", found), ("shingles", s.view(np.int64).tolist())):
                out[name].append(v)
    return out


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b that are similar."""
    left = sets.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * PERCENT).select("a", "b")


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """df written, and its number of rows, taken as it is written."""
    rows = Observation()
    table = written(df.observe(rows, F.count(F.lit(1)).alias("n")), name)
    return table, rows.get["n"]


def components(links: DataFrame) -> DataFrame:
    """v, c: vertices of the links a, b (but for those linked with themselves alone) and the smallest vertex of their component.

    Vertices are ordered by a hash (one to one on bigints), as if shuffled. In a round every vertex goes to the first of
    itself and its neighbours, and once more from there, and edges are drawn anew between where their ends went. A star
    is one vertex after two rounds, a path loses half and more a round: no round reads all links again.
    """
    steps, edges = [], links
    while True:
        drawn = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        edges, left = counted(drawn, "edges")
        if not left:
            break
        near = edges.union(edges.select("b", "a")).select(F.col("a").alias("v"), "b", F.xxhash64("b").alias("h"))
        low = near.groupBy("v").agg(F.min("h").alias("h"), F.min_by("b", "h").alias("m"))
        low = low.select("v", F.when(F.col("h") < F.xxhash64("v"), F.col("m")).otherwise(F.col("v")).alias("m"))
        step = written(low.join(low.select(F.col("v").alias("m"), F.col("m").alias("c")), "m").select("v", "c"), "step")
        steps.append(step)
        edges = edges.join(step.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(step.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b")
        edges = edges.select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    if not steps:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("c"))
    labels = steps[0]
    for step in steps[1:]:
        labels = labels.join(step.select(F.col("v").alias("c"), F.col("c").alias("to")), "c", "left").select("v", F.coalesce("to", "c").alias("c"))
    labels = written(labels, "labels")
    return written(labels.join(labels.groupBy("c").agg(F.min("v").alias("low")), "c").select("v", F.col("low").alias("c")), "lowest")


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (rid, c) after the links between rids."""
    named = links.join(comp.select(F.col("rid").alias("a"), F.col("c").alias("ca")), "a").join(comp.select(F.col("rid").alias("b"), F.col("c").alias("cb")), "b")
    found = components(named.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct())
    return written(comp.join(found.select(F.col("v").alias("c"), F.col("c").alias("to")), "c", "left").select("rid", F.coalesce("to", "c").alias("c")), "components")


def near_in_size(a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= {PERCENT} * greatest({a}, {b})"


def shared_entries(entries: DataFrame) -> DataFrame:
    """The entries (key, rid, n) whose key another document has too, written."""
    shared = entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    return written(entries.join(written(shared, "keys"), "key"), "entries")


def leading(entries: DataFrame) -> DataFrame:
    """The entries of each document's LEADS smallest keys, written; documents that share most of their keys share some of these."""
    least = F.slice(F.array_sort(F.collect_list("key")), 1, LEADS)
    return written(entries.groupBy("rid", "n").agg(least.alias("keys")).select(F.explode("keys").alias("key"), "rid", "n"), "leads")


def link(entries: DataFrame, found: DataFrame) -> DataFrame:
    """rid, c of the candidates (rid, n, shingles): components of the similar among those that share a key of entries (key, rid, n)."""
    comp = written(found.select("rid", F.col("rid").alias("c")), "components")
    leads, tried = leading(entries), None
    for r in range(ROUNDS):
        at = leads.join(comp, "rid")
        # one centre a key: a vote is at most a lead, and most documents of a key are of its centre's component once that is large
        centre = F.min_by(F.struct("rid", "n", "c"), F.xxhash64("rid", F.lit(r))).alias("x")
        centres = at.groupBy("key").agg(centre, F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
        centres = centres.select("key", F.col("x.rid").alias("b"), F.col("x.n").alias("nb"), F.col("x.c").alias("cb"))
        votes = at.join(centres, "key").where(f"c <> cb AND {near_in_size('n', 'nb')}").groupBy(F.col("rid").alias("a"), "b").agg(F.count("*").alias("votes"))
        if tried is not None:
            votes = votes.join(tried, ["a", "b"], "left_anti")
        most = F.slice(F.sort_array(F.collect_list(F.struct("votes", "b")), asc=False), 1, CENTRES)
        pairs, asked = counted(votes.groupBy("a").agg(most.alias("x")).select("a", F.explode("x.b").alias("b")), "pairs")
        links, met = counted(verified(pairs, found), "links")
        both = pairs.union(pairs.select("b", "a"))
        tried = both if tried is None else tried.union(both)
        if not met:
            break
        comp = merged(comp, links)
        if met * WORTH < asked:  # what is left is for cross_links
            break
    links, met = counted(cross_links(entries, comp, found), "links")
    return merged(comp, links) if met else comp


def cross_links(entries: DataFrame, comp: DataFrame, found: DataFrame) -> DataFrame:
    """a, b: links that join all components that share a key and have a link; one for each step of a union."""
    at = entries.join(comp, "rid")
    shared = written(at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("rid").alias("b")).where("lo <> hi").select("key", "b"), "keys")
    near, met = counted(entries.select("key", F.col("rid").alias("a")).join(shared, "key").select("a", "b").distinct(), "near")
    if not met:
        return near
    clusters = components(near).select(F.col("v").alias("rid"), F.col("c").alias("g"))
    # k: similar sets are of the same or neighbouring classes of size
    size_class = F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))).cast("int").alias("k")
    some = written(clusters.join(comp, "rid").join(found.select("rid", "n", size_class), "rid"), "clusters")
    main = some.groupBy("g", "c").agg(F.count("*").alias("m")).groupBy("g").agg(F.max_by("c", F.struct("m", "c")).alias("main"))
    some = written(some.join(main, "g"), "clusters")
    every = some.groupBy("g", "k").agg(F.count("*").alias("all"))
    aimed = F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("k")
    opened = some.where("c <> main").groupBy("g", "k").agg(F.count("*").alias("open")).select("g", "open", aimed)
    opened = opened.groupBy("g", "k").agg(F.sum("open").alias("open"))
    sizes = written(every.join(opened, ["g", "k"]).select("g", "k", F.ceil(F.col("all") / CELL).alias("rows"), F.ceil(F.col("open") / CELL).alias("cols")), "sizes")
    spot = lambda n: F.pmod(F.xxhash64("rid"), n)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    every = some.join(sizes, ["g", "k"]).select("g", "k", spot(F.col("rows")).alias("i"), upto("cols").alias("j"), F.lit(False).alias("open"), "rid", "c")
    opened = some.where("c <> main").select("g", "rid", "c", aimed).join(sizes, ["g", "k"]).select("g", "k", upto("rows").alias("i"), spot(F.col("cols")).alias("j"), F.lit(True).alias("open"), "rid", "c")
    placed = every.unionByName(opened).join(found.select("rid", "n", "shingles"), "rid")
    return placed.groupBy("g", "k", "i", "j").applyInArrow(cell_links, "a bigint, b bigint").distinct()


def cell_links(rows: pa.Table) -> pa.Table:
    """a, b: a link for each union of components of the cell's documents; open ones against all."""
    opened = np.array(rows.column("open").to_pylist())
    rid, c, n = (rows.column(x).to_numpy() for x in ("rid", "c", "n"))
    sets = [np.asarray(x.values) for x in rows.column("shingles")]
    others = np.flatnonzero(~opened)
    links: list[tuple[int, int]] = []
    if len(others) and opened.any():
        tokens = np.concatenate([sets[i] for i in others])
        owner = np.repeat(np.arange(len(others)), [len(sets[i]) for i in others])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                x = up
            return x

        for u in np.flatnonzero(opened):
            lo, hi = np.searchsorted(tokens, sets[u], "left"), np.searchsorted(tokens, sets[u], "right")
            lo, size = lo[hi > lo], (hi - lo)[hi > lo]
            hit = owner[np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())] if len(size) else owner[:0]
            both = np.bincount(hit, minlength=len(others))
            for k in np.flatnonzero((both * 100 >= (n[u] + n[others] - both) * PERCENT) & (c[others] != c[u])):
                x, y = find(int(c[u])), find(int(c[others[k]]))
                if x != y:
                    parent[x] = y
                    links.append((int(rid[u]), int(rid[others[k]])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs, written."""
    with scratch(docs.sparkSession):
        return written(found_classes(docs), "classes", lasting=True)


def named(rows: DataFrame, same: DataFrame, found: DataFrame, comp: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of all rows, by the components of the found (rid, mark, doc_id)."""
    lows = found.select("rid", "mark", "doc_id").join(same.select("mark", "low"), "mark", "left").select("rid", "mark", F.coalesce("low", "doc_id").alias("low"))
    lows = written(lows.join(comp, "rid"), "lows")
    lowest = written(lows.groupBy("c").agg(F.min("low").alias("component_id")), "lowest")
    by_mark = lows.join(lowest, "c").select("mark", "component_id")
    others = same.join(by_mark, "mark", "left_anti").select("mark", F.col("low").alias("component_id"))
    names = written(by_mark.unionByName(others), "named")
    return rows.join(names, "mark", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def found_classes(docs: DataFrame) -> DataFrame:
    blocks = pack(docs, describe)
    rows = members(blocks)
    same = alike(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0

    def every(row: dict) -> np.ndarray:
        sets = [shingles(t) for t in texts(row)]
        return np.concatenate(sets) if sets else np.zeros(0, np.uint64)

    counted = count_keys(blocks.select("block", "lengths", "data"), every, total, 4)
    shape = f"rid bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark string, n bigint, keys array<bigint>, shingles array<bigint>"
    found = written(with_answers(blocks.select("block", "rids", "doc_ids", "marks", "lengths", "data"), counted, candidates, shape, copies(rows, same)), "candidates")
    return named(rows, same, found, link(shared_entries(found.select("rid", "n", F.explode("keys").alias("key"))), found))


def one_of_each(docs: DataFrame, classes: Callable[[DataFrame], DataFrame] = classes) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id (null last), of equal ones the first."""
    hidden, names = veiled(docs)
    rows = written(hidden.select(*names, F.monotonically_increasing_id().alias("row")), "rows")
    doc_id, text = (F.col(f"_in{docs.columns.index(c)}") for c in ("doc_id", "text"))
    found = classes(rows.select(F.col("row").alias("doc_id"), text.alias("text"))).select(F.col("doc_id").alias("row"), "component_id")
    named = found.join(rows.select("row", doc_id.alias("doc_id")), "row")
    first = F.min_by("row", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    kept = written(named.groupBy("component_id").agg(first.alias("row")).select("row"), "kept")
    # kept is never broadcast, as it grows with the documents; it is the side that is hashed, so texts are not sorted
    return unveiled(rows.join(kept.hint("shuffle_hash"), "row", "left_semi"), docs)
