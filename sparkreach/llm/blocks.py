"""Documents in blocks, and counts of 64-bit keys over all blocks.

pack writes whole texts as blocks of about `size` bytes (a longer text is a block of its own), compressed, in the shared
folder. count_keys then tells each block how often each of its keys occurs in all blocks, without a row for each key: a
block sends, for each range of keys (bucket), its sorted distinct keys as one binary value; a bucket, of bounded size
however often one key occurs, is sorted at a time and answers each block in its own order. Keys are cut to `width`
bytes within a bucket, so distinct keys may be counted together, at a rate that falls as buckets grow in number; users
of the counts confirm what they find.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from .common import written

PER_BUCKET = 1 << 20
MOST = 200  # counts above are given as MOST plus their logarithm


def squeeze(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(docs: DataFrame, describe: Callable[[bytes], tuple], size: int = 2 << 20) -> DataFrame:
    """block, rids, doc_ids, marks, sizes (of the marks), extras, lengths, data.

    describe: a text's mark (equal for documents that are alike), its size and, if wanted, numbers of 64 bits. Ids keep their
    type.
    """
    kind = docs.schema["doc_id"].dataType
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 20
        held, total = [], 0

        def out():
            marks = [describe(t) for _, t in held]
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    one([(block << 20) + i for i in range(len(held))], pa.int64()),
                    one([d for d, _ in held], arrow_kind),
                    one([m[0] for m in marks], pa.string()),
                    one([m[1] for m in marks], pa.int64()),
                    one([m[2] if len(m) > 2 else None for m in marks], pa.list_(pa.int64())),
                    one([len(t) for _, t in held], pa.int64()),
                    pa.array([squeeze(b"".join(t for _, t in held))], pa.binary()),
                ],
                names=["block", "rids", "doc_ids", "marks", "sizes", "extras", "lengths", "data"],
            )

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = (text.as_py() or "").encode("utf-8", "surrogatepass")
                held.append((doc_id, t))
                total += len(t) + 64
                if total >= size:
                    yield out()
                    block, held, total = block + 1, [], 0
        if held:
            yield out()

    shape = f"block bigint, rids array<bigint>, doc_ids array<{kind.simpleString()}>, marks array<string>, sizes array<bigint>, extras array<array<bigint>>, lengths array<bigint>, data binary"
    return written(docs.select("doc_id", "text").mapInArrow(run, shape), "blocks", "none")


def members(blocks: DataFrame, *more: str) -> DataFrame:
    """block, rid, doc_id, mark, size, length (and extra), one row a document, written."""
    names = {"rids": "rid", "doc_ids": "doc_id", "marks": "mark", "sizes": "size", "lengths": "length", **{f"{m}s": m for m in more}}
    rows = blocks.select("block", F.explode(F.arrays_zip(*names)).alias("x"))
    return written(rows.select("block", *(F.col(f"x.{k}").alias(v) for k, v in names.items())), "members")


def alike(rows: DataFrame) -> DataFrame:
    """mark, rep (smallest rid), low (smallest doc_id), n of marks that more than one document has, written. Summed before the shuffle."""
    return written(rows.where("mark IS NOT NULL").groupBy("mark").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1"), "alike")


def copies(rows: DataFrame, same: DataFrame) -> DataFrame:
    """block, copies: place and n of documents of classes; n is 0 for those that another one stands for, else the class's size.

    Both sides are written tables, so a mark that many rows share is split.
    """
    place = (F.col("rid") - F.shiftleft(F.col("block"), 20)).cast("int").alias("place")
    n = F.when(F.col("rid") == F.col("rep"), F.least(F.col("n"), F.lit(1 << 30))).otherwise(0).cast("int").alias("n")
    return written(rows.select("block", "rid", "mark").join(same.select("mark", "rep", "n"), "mark").groupBy("block").agg(F.collect_list(F.struct(place, n)).alias("copies")), "copies")


def buckets_for(total: int) -> int:
    """The power of two of the number of buckets for so many keys."""
    return max(1, math.ceil(math.log2(max(1, total / PER_BUCKET))))


def cut(keys: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys: the buckets that have some, their places' bounds, and their bytes within them."""
    at = keys >> np.uint64(64 - k)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
    return at[first].astype(np.int64), np.append(first, len(at)), ((keys << np.uint64(k)) >> np.uint64(64 - 8 * width)).view(np.uint8).reshape(-1, 8)[:, :width]


def count_keys(blocks: DataFrame, keys: Callable[[dict], np.ndarray], total: int, width: int) -> DataFrame:
    """block, bucket, counts (one byte for each of the block's sorted distinct keys in the bucket, compressed).

    keys: the uint64 keys of a row of blocks, in any order, with repeats.
    """
    k = buckets_for(total)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                found, n = np.unique(keys(row), return_counts=True)
                at, bounds, raw = cut(found, k, width)
                n = np.minimum(n, 255).astype(np.uint8)
                some = list(zip(bounds[:-1], bounds[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(at, pa.int32()),
                        pa.array([row["block"]] * len(at), pa.int64()),
                        pa.array([raw[a:z].tobytes() for a, z in some], pa.binary()),
                        pa.array([squeeze(n[a:z].tobytes()) for a, z in some], pa.binary()),
                    ],
                    names=["bucket", "block", "keys", "n"],
                )

    def answer(table: pa.Table) -> pa.Table:
        blobs = [x.as_py() for x in table.column("keys")]
        sizes = np.array([len(x) // width for x in blobs])
        raw = np.zeros((sizes.sum(), 8), np.uint8)
        raw[:, :width] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
        found = raw.view(np.uint64).ravel()
        n = np.frombuffer(b"".join(expand(x.as_py()) for x in table.column("n")), np.uint8).astype(np.int64)
        order = np.argsort(found, kind="stable")
        ranked = found[order]
        starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        sums = np.add.reduceat(n[order], starts)
        sums = np.where(sums > MOST, np.minimum(255, MOST + np.log2(np.maximum(sums, 1)).astype(np.int64)), sums).astype(np.uint8)
        out = np.empty(len(found), np.uint8)
        out[order] = np.repeat(sums, np.diff(np.concatenate((starts, [len(found)]))))
        ends = np.cumsum(sizes)
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "counts": pa.array([squeeze(out[e - s : e].tobytes()) for s, e in zip(sizes, ends, strict=True)], pa.binary())})

    sent = blocks.mapInArrow(emit, "bucket int, block bigint, keys binary, n binary")
    return sent.groupBy("bucket").applyInArrow(answer, "block bigint, bucket int, counts binary")


def counts_of(rows: list[dict]) -> np.ndarray:
    """The counts of a block's sorted distinct keys from its answers."""
    rows = sorted(rows, key=lambda r: r["bucket"])
    return np.frombuffer(b"".join(expand(r["counts"]) for r in rows), np.uint8) if rows else np.zeros(0, np.uint8)


def with_answers(blocks: DataFrame, answers: DataFrame, f: Callable[[dict, np.ndarray, dict[int, int]], dict[str, list]], schema: str, copied: DataFrame | None = None) -> DataFrame:
    """f(block's row, its counts, place to n of copies) for each block: lists by column of schema. Blocks meet their answers by block, which is even."""
    out = to_arrow_schema(T.StructType.fromDDL(schema))
    told = answers.withColumn("copies", F.lit(None).cast("array<struct<place:int,n:int>>"))
    if copied is not None:
        told = told.unionByName(copied.select("block", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("counts"), "copies"))

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        rows = found.to_pylist()
        got: dict[str, list] = {n: [] for n in out.names}
        for row in block.to_pylist():  # one: block is a key
            new = f(row, counts_of([r for r in rows if r["bucket"] is not None]), {x["place"]: x["n"] for r in rows if r["bucket"] is None for x in r["copies"]})
            for n in out.names:
                got[n] += new[n]
        return pa.table([pa.array(got[n], t) for n, t in zip(out.names, out.types, strict=True)], schema=out)

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)
