"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over all characters as they stand, of order `ORDER`. Trusted text is that of documents labelled good and
not toxic, three quarters of them; counts cover all of it and are summed in shards by n-gram. Joins of the count tables
with their context totals (by order, sharded by context) give discounted probabilities and back-off weights: a table of
n-grams that grows with the trusted text. It stays in shards. Documents are packed in blocks, a table bucketed by
block; a block sends each shard its distinct n-grams of all orders and contexts as one value, and its answers come to
where it lies. Characters are compared
themselves, no hashes of them.

Below single characters the model interpolates with one over `SIZE` classes of folded characters (blanks, digits,
capitals, the commonest others over all documents, and the rest), evenly within a class. This judges characters that
trusted text lacks. It is made of the same counts, and has SIZE ** ORDER numbers.

The last quarter of the trusted documents sets the threshold of each language: the `QUANTILE` of their perplexities,
over all languages where a language has fewer than `LEAST` of them. Documents above it are rejected.

Cases: null and empty texts have no perplexity and are rejected; a null or unseen language uses the overall
threshold; without trusted documents everything with text is kept; labels repeated for a document must all be good; repeated
rows are scored alike, and count as often as they stand in trusted text; texts are scored whole, a long one in several
blocks; an empty table gives no rows; further columns, whatever their names, are not looked at and clean keeps them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import buckets_for, expand, squeeze
from .common import bucketed, scratch, unveiled, veiled, written

ORDER, SIZE = 4, 32
QUANTILE, LEAST = 0.99, 50
CHUNK = 1 << 20  # characters counted at a time
BLOCK = 3 << 19  # characters of a block
BITS = 21  # of a character's code: its code point and one; 0 stands for none
LOW = (1 << BITS) - 1
HELD = 1 << 18  # rows of the model sent as one
BLANK, CAPITAL, NUMBER = 0x20, 0x41, 0x30


def folded() -> np.ndarray:
    """Code point to the code point that stands for it."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isspace():
            table[c] = BLANK
        elif x.isupper():
            table[c] = CAPITAL
        elif x.isdecimal():
            table[c] = NUMBER
    return table


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def alphabet(docs: DataFrame) -> list[int]:
    """The commonest SIZE - 1 folded code points of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, n = folded(), np.zeros(0x110000, np.int64)
        for b in batches:
            for some in chunks([t for t in b.column(0).to_pylist() if t]):
                got = np.bincount(points("".join(some)))
                n[: len(got)] += got
        total = np.bincount(fold, weights=n, minlength=len(n)).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["c", "n"])

    counted = docs.select("text").mapInArrow(run, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
    return [r["c"] for r in counted.orderBy(F.desc("n"), "c").limit(SIZE - 1).collect()]


def classes(letters: list[int]) -> np.ndarray:
    """Code point to class; 0: the rest."""
    table = np.zeros(0x110000, np.uint32)
    for i, c in enumerate(letters):
        table[c] = i + 1
    return table[folded()]


@functools.lru_cache(1)
def classes_of(letters: tuple[int, ...]) -> np.ndarray:
    """classes, kept in the process: a task has many groups."""
    return classes(list(letters))


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams that end in a character (rows of code points), which of them ends in each, and the place after each text's last one."""
    pad = " " * (ORDER - 1)
    c = points(pad + pad.join(texts))
    seen = np.zeros(0x110000, bool)
    seen[c] = True
    size = int(seen.sum())
    r = (np.cumsum(seen) - 1)[c]
    n = len(c) - ORDER + 1
    key = np.zeros(n, np.int64)
    for k in range(ORDER):
        if k == ORDER - 1 and size**ORDER >= 1 << 63:
            key = pd.factorize(key)[0].astype(np.int64)
        key = key * size + r[k : n + k]
    # texts are ORDER - 1 characters apart; n-grams that end in padding are left out
    ends = np.cumsum([len(t) for t in texts])
    keep = np.ones(n, bool)
    gaps = ends[:-1] + np.arange(len(texts) - 1) * (ORDER - 1)
    for k in range(ORDER - 1):
        keep[gaps + k] = False
    which, distinct = pd.factorize(key[keep])
    first = np.empty(len(distinct), np.int64)
    first[which[::-1]] = np.flatnonzero(keep)[::-1]
    return c[first[:, None] + np.arange(ORDER)], which, ends


def coded(quads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams as numbers: all characters but the last, and the last."""
    q = quads.astype(np.int64) + 1
    h = np.zeros(len(q), np.int64)
    for k in range(q.shape[1] - 1):
        h = h << BITS | q[:, k]
    return h, q[:, -1]


def told_apart(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each pair, equal for equal pairs, and the first place of each number."""
    which, distinct = pd.factorize(pd.factorize(h)[0].astype(np.int64) << BITS | d)
    first = np.empty(len(distinct), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    return which, first


def shard(h: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """The shards, of 2 ** k, of n-grams."""
    x = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ d.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ x >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - k)).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Numbers by byte of them, which compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def joined(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def asked(quads: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a block asks for, by shard: shards, first characters and last of its n-grams and contexts; and where each n-gram's are.

    Rows of the last: n-grams of order ORDER, .., 1, then contexts of ORDER - 1, .., 1 characters.
    """
    parts = [quads[:, i:] for i in range(ORDER)] + [quads[:, i:-1] for i in range(ORDER - 1)]
    h, d = (np.concatenate(x) for x in zip(*map(coded, parts), strict=True))
    which, first = told_apart(h, d)
    h, d = h[first], d[first]
    at = shard(h, d, k)
    order = np.lexsort((d, h, at))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return at[order], h[order], d[order], place[which].reshape(2 * ORDER - 1, -1)


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id of documents whose labels are all good; part: 0 to set thresholds, 1 to 3 to count."""
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND coalesce(t, 0) = 0")
    return good.select("doc_id", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)).alias("part"))


def pack(docs: DataFrame, columns: list[str], key: str) -> DataFrame:
    """block, doc_ids, size (what the block asks for), data: columns and text of some documents, as Arrow. key: the doc_id's column."""
    kind = docs.schema[key].dataType.simpleString()
    shape = f"block bigint, doc_ids array<{kind}>, size bigint, data binary"
    out = to_arrow_schema(T.StructType.fromDDL(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, total = TaskContext.get().partitionId() << 20, [], 0

        def one() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            rows = pa.Table.from_batches(held).combine_chunks()
            kept = rows.select(range(1, rows.num_columns))
            with pa.ipc.new_stream(sink, kept.schema) as w:
                w.write_table(kept)
            texts = [t for t in rows.column(rows.num_columns - 1).to_pylist() if t]
            size = len(asked(windows(texts)[0], 1)[0]) if texts else 0
            values = ([block], [rows.column(0).to_pylist()], [size], [squeeze(sink.getvalue().to_pybytes())])
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, out.types, strict=True)], schema=out)

        for b in batches:
            sizes = pc.fill_null(pc.utf8_length(b.column(b.num_columns - 1)), 0).to_pylist()
            start = 0
            for i, n in enumerate(sizes):
                total += n + 64
                if total >= BLOCK:
                    held.append(b.slice(start, i + 1 - start))
                    yield one()
                    block, held, total, start = block + 1, [], 0, i + 1
            if start < b.num_rows:
                held.append(b.slice(start))
        if held:
            yield one()

    return docs.select(F.col(key).alias("_key"), *columns, F.col("text").alias("_text")).mapInArrow(run, shape)


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(expand(data)).read_all().combine_chunks()


def gram_counts(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """h, d, n: the n-grams of trusted text, as coded, written. Which documents are trusted joins the blocks by block, in one bit or so a document."""
    part = trusted(labels).where("part > 0").select("doc_id")
    ids = blocks.select("block", F.posexplode("doc_ids").alias("place", "doc_id"))
    places = ids.join(part, "doc_id").groupBy("block").agg(F.sort_array(F.collect_list("place")).alias("places"))
    some = blocks.select("block", "data").join(written(places, "trusted"), "block").select("places", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                rows = unpacked(row["data"])
                texts = [t for t in rows.column(rows.num_columns - 1).take(pa.array(row["places"])).to_pylist() if t]
                if texts:
                    quads, which, _ = windows(texts)
                    h, d = coded(quads)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(d.astype(np.int32)), pa.array(np.bincount(which, minlength=len(h)))], names=["h", "d", "n"])

    return written(some.mapInArrow(run, "h bigint, d int, n bigint").groupBy("h", "d").agg(F.sum("n").alias("n")), "grams")


def class_counts(grams: DataFrame, letters: list[int]) -> DataFrame:
    """g, n: the n-grams of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut, n = classes(letters), np.zeros(SIZE**ORDER, np.int64)
        for b in batches:
            h, d, m = (b.column(i).to_numpy() for i in range(3))
            g = np.zeros(len(h), np.int64)
            for k in range(ORDER - 2, -1, -1):
                g = g * SIZE + lut[(h >> BITS * k & LOW) - 1]
            np.add.at(n, g * SIZE + lut[d - 1], m)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[seen])], names=["g", "n"])

    return grams.mapInArrow(run, "g int, n bigint").groupBy("g").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ of a count table."""
    n = dict(counts.where("n <= 4").groupBy("n").count().collect())
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def model(grams: DataFrame, letters: list[int]) -> np.ndarray:
    """log2 of P(last class | the others), at the number of each n-gram of classes."""
    table = written(class_counts(grams, letters), "grams")
    lower = np.full(1, 1.0 / SIZE)  # below single characters: uniform
    levels = [table]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many different characters stand before
        levels.append(written(levels[-1].groupBy((F.col("g") % SIZE**k).alias("g")).agg(F.count("*").alias("n")), "grams"))
    for k, counts in enumerate(reversed(levels), 1):
        d1, d2, d3 = discounts(counts)
        off = F.when(F.col("n") == 1, F.lit(d1)).when(F.col("n") == 2, d2).otherwise(d3)
        counts = counts.select("g", "n", F.expr(f"g div {SIZE}").cast("int").alias("h"), off.alias("off"))
        held = counts.groupBy("h").agg(F.sum("n").alias("total"), F.sum("off").alias("free"))
        joined = counts.join(held, "h").select("g", "h", (F.greatest(F.col("n") - F.col("off"), F.lit(0.0)) / F.col("total")).alias("p"), (F.col("free") / F.col("total")).alias("back"))
        got = joined.toArrow()  # SIZE ** k rows at most
        p, back = np.zeros(SIZE**k), np.ones(SIZE ** (k - 1))
        g, h = got.column("g").to_numpy(), got.column("h").to_numpy()
        p[g] = got.column("p").to_numpy()
        back[h] = got.column("back").to_numpy()
        shorter = np.tile(lower, SIZE**k // len(lower)) if k > 1 else np.full(SIZE, 1.0 / SIZE)
        lower = p + np.repeat(back, SIZE) * shorter
    rows = lower.reshape(-1, SIZE)
    return np.log2(rows / rows.sum(axis=1, keepdims=True)).astype(np.float32).ravel()


def weights(grams: DataFrame) -> tuple[DataFrame, float]:
    """h, d, p (null where it is a context alone), back (null where it is an n-gram alone), of all orders, written; and the weight below single characters."""
    levels = [grams]
    for k in range(ORDER - 2, -1, -1):
        levels.append(written(levels[-1].groupBy(F.col("h").bitwiseAND((1 << BITS * k) - 1).alias("h"), "d").agg(F.count("*").alias("n")), "grams"))
    rows, least = [], 1.0
    for k, counts in enumerate(levels):
        cuts = discounts(counts)
        off = F.when(F.col("n") == 1, F.lit(cuts[0])).when(F.col("n") == 2, cuts[1]).otherwise(cuts[2])
        # counted before they are weighed, so that sums do not hang on their order
        free = sum((F.count_if(c) * d for c, d in zip((F.col("n") == 1, F.col("n") == 2, F.col("n") > 2), cuts, strict=True)), F.lit(0.0))
        p = F.greatest(F.col("n") - off, F.lit(0.0)) / F.col("total")
        if k < ORDER - 1:
            held = written(counts.groupBy("h").agg(F.sum("n").alias("total"), free.alias("free")), "contexts")
            rows.append(counts.join(held, "h").select("h", "d", p.alias("p"), F.lit(None).cast("double").alias("back")))
            rows.append(held.select(F.shiftright("h", BITS).alias("h"), F.col("h").bitwiseAND(LOW).cast("int").alias("d"), F.lit(None).cast("double").alias("p"), (F.col("free") / F.col("total")).alias("back")))
        else:
            total, unused = counts.agg(F.sum("n"), free).first()
            least = unused / total if total else 1.0
            rows.append(counts.withColumn("total", F.lit(total)).select("h", "d", p.alias("p"), F.lit(None).cast("double").alias("back")))
    return written(functools.reduce(DataFrame.unionByName, rows), "weights"), least


def sent(at: np.ndarray, block: int, *columns: np.ndarray) -> pa.RecordBatch:
    """A row for each shard, of columns sorted by shard."""
    where = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
    ends = np.append(where[1:], len(at))
    blobs = [[squeeze(planes(c[a:b])) for a, b in zip(where, ends, strict=True)] for c in columns]
    blobs += [[None] * len(where)] * (4 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(at[where], pa.int32()), pa.array([block] * len(where), pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)], names=["shard", "block", "h", "d", "p", "back"])


def answers(blocks: DataFrame, table: DataFrame) -> DataFrame:
    """block, shard, p, back: the weights of what the blocks ask for, in their order; 0 and 1 where trusted text has none."""
    k = buckets_for((blocks.agg(F.sum("size")).first()[0] or 0) + table.count())
    shape = "shard int, block bigint, h binary, d binary, p binary, back binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                texts = [t for t in unpacked(row["data"]).columns[-1].to_pylist() if t]
                if texts:
                    at, h, d, _ = asked(windows(texts)[0], k)
                    yield sent(at, row["block"], h, d.astype(np.int32))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= HELD:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        h, d, p, back = (rows.column(i).to_numpy() for i in range(4))
        at = shard(h, d, k)
        order = np.lexsort((d, h, at))
        return sent(at[order], -1, h[order], d[order], p[order].astype(np.float32), back[order].astype(np.float32))

    def answer(rows: pa.Table) -> pa.Table:
        column = lambda name, kind: [joined(expand(x), kind) for x in rows.column(name).to_pylist() if x is not None]
        known = np.array([x is not None for x in rows.column("p").to_pylist()])
        h, d = column("h", np.int64), column("d", np.int32)
        sizes = [len(x) for x in h]
        which, first = told_apart(np.concatenate(h), np.concatenate(d))
        own = which[np.repeat(known, sizes)]
        p, back = np.zeros(len(first), np.float32), np.ones(len(first), np.float32)
        for values, name in ((p, "p"), (back, "back")):
            got = np.concatenate([np.zeros(0, np.float32), *column(name, np.float32)])
            values[own[~np.isnan(got)]] = got[~np.isnan(got)]
        ends = np.cumsum(sizes)
        some = [(i, which[ends[i] - sizes[i] : ends[i]]) for i in np.flatnonzero(~known)]
        back_to = pa.array([i for i, _ in some], pa.int64())
        blobs = [pa.array([squeeze(planes(v[w])) for _, w in some], pa.binary()) for v in (p, back)]
        return pa.table({"block": rows.column("block").take(back_to), "shard": rows.column("shard").take(back_to), "p": blobs[0], "back": blobs[1]})

    every = blocks.select("block", "data").mapInArrow(ask, shape).unionByName(table.select("h", "d", "p", "back").mapInArrow(tell, shape))
    return every.groupBy("shard").applyInArrow(answer, "block bigint, shard int, p binary, back binary")


def score(blocks: DataFrame, grams: DataFrame, letters: list[int], logs: np.ndarray, docs: DataFrame, columns: list[str]) -> DataFrame:
    """columns of docs, which blocks hold, with ppl."""
    held = docs.sparkSession.sparkContext.broadcast(logs)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", ppl double"
    out = to_arrow_schema(T.StructType.fromDDL(schema))
    table, least = weights(grams)
    k = buckets_for((blocks.agg(F.sum("size")).first()[0] or 0) + table.count())

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        lut, told = classes_of(tuple(letters)), sorted(found.to_pylist(), key=lambda r: r["shard"])
        rows = unpacked(block.column("data")[0].as_py())
        texts = rows.columns[-1].to_pylist()
        ppl = np.full(len(texts), np.nan)
        at = [i for i, t in enumerate(texts) if t]
        if at:
            quads, which, ends = windows([texts[i] for i in at])
            place = asked(quads, k)[3]
            p, back = (np.concatenate([joined(expand(r[n]), np.float32) for r in told]).astype(np.float64) for n in ("p", "back"))
            g = np.zeros(len(quads), np.int64)
            for i in range(ORDER):
                g = g * SIZE + lut[quads[:, i]]
            prob = np.exp2(held.value[g].astype(np.float64)) / np.maximum(np.bincount(lut, minlength=SIZE), 1)[lut[quads[:, -1]]]
            prob = p[place[ORDER - 1]] + least * prob
            for i in range(ORDER - 2, -1, -1):
                prob = p[place[i]] + back[place[ORDER + i]] * prob
            sums = np.diff(np.concatenate(([0.0], np.cumsum(np.log2(prob)[which])))[np.concatenate(([0], ends))])
            ppl[at] = np.exp2(-sums / np.diff(np.concatenate(([0], ends))))
        got = [rows.column(i).cast(t) for i, t in zip(range(len(columns)), out.types, strict=False)]
        return pa.table([*got, pa.array(ppl, pa.float64(), mask=np.isnan(ppl))], schema=out)

    return blocks.select("block", "data").groupBy("block").cogroup(answers(blocks, table).groupBy("block")).applyInArrow(run, schema)


def with_kept(scored: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """scored (with key, lang, ppl) with kept: ppl is at most its language's threshold, or the overall one."""
    held = scored.where("ppl IS NOT NULL").select(F.col(key).alias("doc_id"), "lang", "ppl").join(trusted(labels).where("part = 0"), "doc_id")
    quantile = F.percentile_approx("ppl", QUANTILE, 10000)
    overall = held.agg(quantile).first()[0]
    if overall is None:
        return scored.withColumn("kept", F.col("ppl").isNotNull())
    limits = written(held.groupBy("lang").agg(quantile.alias("_most"), F.count("*").alias("n")).where(f"lang IS NOT NULL AND n >= {LEAST}").drop("n"), "thresholds")
    judged = F.coalesce(F.col("ppl") <= F.coalesce("_most", F.lit(overall)), F.lit(False))
    return scored.join(limits, "lang", "left").withColumn("kept", judged).drop("_most")


def train(docs: DataFrame, labels: DataFrame, grams: DataFrame | None = None) -> tuple[list[int], np.ndarray]:
    """The classes' letters and model. grams: the counts of docs' trusted text, if they are known."""
    letters = alphabet(docs)
    return letters, model(gram_counts(written(pack(docs, [], "doc_id"), "blocks"), labels) if grams is None else grams, letters)


def with_lang(docs: DataFrame) -> DataFrame:
    return docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))


def scored(docs: DataFrame, labels: DataFrame, columns: list[str], key: str) -> DataFrame:
    """columns of docs with ppl, written."""
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    with scratch(docs.sparkSession), bucketed(pack(docs, columns, key), "ngrams", "block", max(1, -(-size // (8 * BLOCK)))) as blocks:
        grams = gram_counts(blocks, labels)
        return written(score(blocks, grams, *train(docs, labels, grams), docs, columns), "scored", lasting=True)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, ppl, kept for each row of docs."""
    found = scored(with_lang(docs), labels, ["doc_id", "lang"], "doc_id")
    return with_kept(found, labels).select("doc_id", "lang", "ppl", "kept")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept."""
    hidden, names = veiled(docs)
    hidden = hidden.withColumn("lang", hidden[f"_in{docs.columns.index('lang')}"] if "lang" in docs.columns else F.lit(None).cast("string"))
    key = f"_in{docs.columns.index('doc_id')}"
    found = scored(hidden, labels, [*names, "lang"], key)
    return unveiled(with_kept(found, labels, key).where("kept"), docs)
