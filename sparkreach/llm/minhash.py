"""MinHash near-dedup by min-max hashing: smallest and largest value under each permutation, banded, links confirmed.

A document's set: its distinct five-word shingles. Under a random permutation two sets agree in their smallest member
with a probability equal to their similarity, and in their largest likewise, so both are kept: PERMUTATIONS hashes of
each shingle give twice as many signature values, and as a set's smallest and largest are hardly ever the same member,
the share of equal values estimates similarity with no bias and no more variance than as many separate permutations.
Values are dealt into bands of ROWS of different permutations, whose digests are the keys of the index. With 30 bands
of 5 two sets at the limit of 0.85 share no key once in some 40 million pairs, those at 0.5 share one in 3 of 5.

Equal sets are told apart first by a 128-bit digest; one document stands for them, so a group of copies is one entry.
Documents that share a key are linked after their whole sets have been compared (see ngram_join.link: rounds against a
few centres of each key, then all that is left in cells of bounded size), so no pair in a key is taken on trust and none
is left out. Keys of all documents are written with the blocks; sets are made again for those alone that share a key.

Cases: null and blank texts have no shingles and are linked with nothing; fewer than five words are one shingle; sets of
fewer than seven shingles are similar to equal ones only; equal texts and repeated rows are of one component; a null
doc_id never names a component that has another, and is kept only where no row of its component has an id. Ids may be
of any ordered type. Texts of any length are taken whole; an empty table gives no rows; further columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_join
from .blocks import alike, members, pack
from .common import scratch, written
from .ngram_join import PERCENT, link, named, shared_entries, shingles, texts

SHINGLE = 5
PERMUTATIONS, ROWS = 75, 5
LEAST = -(-100 // (100 - PERCENT))  # smaller sets are similar to equal ones alone
CHUNK = 2048


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return np.array([xxhash.xxh3_64_intdigest(f"{seed}/{i}") for i in range(n)], np.uint64)


TIMES, PLUS = stream(1, PERMUTATIONS) | np.uint64(1), stream(2, PERMUTATIONS)


def signature(s: np.ndarray) -> np.ndarray:
    """The smallest value of s under each permutation of 64-bit numbers, then the largest under each."""
    low, high = np.full(PERMUTATIONS, -1, np.int64).view(np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(s), CHUNK):
        h = np.multiply.outer(TIMES, s[at : at + CHUNK])
        h += PLUS[:, None]
        low, high = np.minimum(low, h.min(axis=1)), np.maximum(high, h.max(axis=1))
    return np.concatenate((low, high))


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each ROWS values, the band's number mixed in."""
    return np.array([xxhash.xxh3_64_intdigest(values[i : i + ROWS].tobytes(), seed=i) for i in range(0, len(values), ROWS)], np.uint64).view(np.int64)


def describe(text: bytes) -> tuple[str | None, int, np.ndarray | None]:
    s = shingles(text, SHINGLE)
    return (xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None), len(s), bands(signature(s)) if len(s) >= LEAST else None


def sets_of(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """rid, n, shingles of the wanted (block, rid), written."""
    places = wanted.groupBy("block").agg(F.collect_list("rid").alias("wanted"))

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        rids, found = [], []
        if asked.num_rows:
            asked_for = set(asked.column("wanted")[0].as_py())
            for row in block.to_pylist():  # one: block is a key
                for rid, t in zip(row["rids"], texts(row), strict=True):
                    if rid in asked_for:
                        rids.append(rid)
                        found.append(shingles(t, SHINGLE).view(np.int64))
        return pa.table({"rid": pa.array(rids, pa.int64()), "n": pa.array([len(s) for s in found], pa.int64()), "shingles": pa.array(found, pa.list_(pa.int64()))})

    some = blocks.select("block", "rids", "lengths", "data").groupBy("block").cogroup(places.groupBy("block"))
    return written(some.applyInArrow(run, "rid bigint, n bigint, shingles array<bigint>"), "sets")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs, written."""
    with scratch(docs.sparkSession):
        return written(found_classes(docs), "classes", lasting=True)


def found_classes(docs: DataFrame) -> DataFrame:
    blocks = pack(docs, describe)
    rows = members(blocks, "extra")
    same = alike(rows)
    first = rows.where("extra IS NOT NULL").join(same.select("mark", "rep"), "mark", "left").where("rep IS NULL OR rep = rid")
    first = written(first.select("block", "rid", "doc_id", "mark", F.col("size").alias("n"), "extra"), "first")
    entries = shared_entries(first.select("rid", "n", F.explode("extra").alias("key")))
    wanted = first.select("block", "rid", "doc_id", "mark").join(entries.select("rid").distinct(), "rid", "left_semi")
    return named(rows, same, first, link(entries, sets_of(blocks, wanted)))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return classes(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id (null last), of equal ones the first."""
    return ngram_join.one_of_each(docs, classes)
