"""Filter interaction audit: what each filter removes, alone and after others, in every order of five filters.

One pass over the bytes of a text takes its counts. The pass is a transducer over UTF-8 driven by a table: the class of
a byte gives its outputs (a code point begins, a capital, a symbol) and its next state (in a word or between words).
As the next state depends on the byte's class alone, the states of a chunk of texts come from one lookup, and a word
begins or ends where neighbouring states differ or a text ends. Each word's span goes into an open hash table of the
chunk, with its text's number as a part of the key: an occupied slot counts as the same word only after owner, length
and all bytes have been compared, else the span moves on to the next slot. Spans of a text that opened a slot are its
distinct words.

Filters are bits of a mask. Equal texts (by 256-bit digest; their counts are equal too) are grouped by digest after a
sum by row id, so a text of a third of all rows is one small row for each task. What is left, rows by part, mask and
labels, is at most 128 a part, whatever the input; orders and steps are numbers taken from it.

Cases: a null text is empty, a null lang an empty part; no words: under 200, and not under half distinct; rows of equal
ids are of the same age, so neither of two such copies is the later one; a row without an id is later than all with one
and fails for a copy only if an id has the text; labels count if any of a row's labels says so, and labels of unknown
rows are left out; texts are taken whole at any length; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

CHUNK = 4 << 20  # bytes scanned at a time; a longer text is a chunk by itself

IN_WORD, POINT, CAPITAL, SYMBOL = 1, 2, 4, 8
#: What a byte is: the state after it (in a word or not), whether a code point begins with it, whether it is a capital or a symbol.
TABLE = np.array([IN_WORD * (b != 0x20 and not 0x09 <= b <= 0x0D) | POINT * (b & 0xC0 != 0x80) | CAPITAL * (0x41 <= b <= 0x5A) | SYMBOL * (b in b"#$%&*|") for b in range(256)], np.uint8)

#: Filters in the order of their bits; what a row has to meet to fail. The last one is told apart by `first`.
FILTERS = {"A": "n_words < 200", "B": "100 * n_distinct < 50 * n_words", "C": "100 * n_capitals > 3 * n_points", "D": "n_symbols > 0"}
COPY = "E"
LETTERS = "".join(FILTERS) + COPY

A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def pieces(view: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next up to 8 bytes from starts as numbers."""
    return view[starts] & MASKS[np.minimum(left, 8)]


def distinct(view: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Whether each span is the first of its owner with its bytes. view: the 8 bytes from each place on."""
    h = (owners.astype(np.uint64) * B) ^ lengths.astype(np.uint64)
    left, j = np.arange(len(starts)), 0
    while len(left):
        x = (h[left] ^ pieces(view, starts[left] + j, lengths[left] - j)) * A
        h[left] = x ^ (x >> np.uint64(32))
        j += 8
        left = left[lengths[left] > j]
    size = 1 << max(4, (2 * len(starts)).bit_length())
    table = np.full(size, -1, np.int64)
    slot = (h & np.uint64(size - 1)).astype(np.int64)
    opened = np.zeros(len(starts), bool)
    pending = np.arange(len(starts))
    while len(pending):
        s = slot[pending]
        free = table[s] < 0
        table[s[free][::-1]] = pending[free][::-1]  # of several spans the first one has the slot
        held = table[s]
        opened[pending[held == pending]] = True
        same = (owners[held] == owners[pending]) & (lengths[held] == lengths[pending])
        check, j = np.flatnonzero(same & (held != pending)), 0
        while len(check):
            p, q = pending[check], held[check]
            rest = lengths[p] - j
            equal = pieces(view, starts[p] + j, rest) == pieces(view, starts[q] + j, rest)
            same[check[~equal]] = False
            j += 8
            check = check[equal & (rest > 8)]
        pending = pending[~same]
        slot[pending] = (slot[pending] + 1) & (size - 1)
    return opened


def counts(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of the texts between bounds of data."""
    n = len(bounds) - 1
    told = TABLE[data]
    state = (told & IN_WORD).astype(bool)
    before = np.concatenate(([False], state[:-1])) if len(state) else state
    inner = bounds[:-1][bounds[:-1] < len(state)]
    before[inner] = False
    starts = np.flatnonzero(state & ~before)
    after = np.concatenate((state[1:], [False])) if len(state) else state
    last = bounds[1:][bounds[1:] > 0] - 1
    after[last[last < len(state)]] = False
    ends = np.flatnonzero(state & ~after) + 1
    upto = lambda places: np.searchsorted(places, bounds)
    words = np.diff(upto(starts))
    owners = np.repeat(np.arange(n), words)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    view = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, 0, (1,))
    new = distinct(view, starts, ends - starts, owners)
    many = lambda bit: np.diff(upto(np.flatnonzero(told & bit)))
    return [words, np.bincount(owners[new], minlength=n), many(CAPITAL), np.diff(bounds) - np.diff(upto(np.flatnonzero((told & POINT) == 0))), many(SYMBOL)]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of texts and their bounds, about size bytes at a time; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def scan(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, part, digest, n_words, n_distinct, n_capitals, n_points, n_symbols of each row of docs."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, found = [], [[] for _ in COUNTS]
            for data, bounds in chunks(b.column(2), chunk):
                for old, new in zip(found, counts(data, bounds), strict=True):
                    old.append(new)
                digests += [hashlib.sha256(data[a:z]).digest() for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            columns = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(to_arrow_type(kind)), b.column(1), pa.array(digests, pa.binary()), *columns], names=["doc_id", "part", "digest", *COUNTS])

    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    return docs.select("doc_id", part, "text").mapInArrow(run, f"doc_id {kind.simpleString()}, part string, digest binary, " + ", ".join(f"{c} bigint" for c in COUNTS))


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (a bit for each filter that fails), good, toxic, n: the rows of docs, counted."""
    mask = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(FILTERS.values())), F.lit(0))
    rows = scan(docs).select("doc_id", "part", "digest", mask.alias("mask"))
    known = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    alike = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("doc_id", *alike).agg(F.count("*").alias("n"))
    alike = by_id.groupBy(*alike).agg(F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low"))
    lowest = alike.withColumn("first", F.min("low").over(Window.partitionBy("digest")))  # a few rows a text: one for each lang and label
    first = F.when(F.col("first").isNull(), F.col("n")).when(F.col("low") == F.col("first"), F.col("n_low")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("mask"), first.alias("n")), F.struct((F.col("mask") + (1 << len(FILTERS))).alias("mask"), (F.col("n") - first).alias("n"))))
    split = lowest.select("part", "good", "toxic", both.alias("x")).select("part", "good", "toxic", "x.mask", "x.n")
    return split.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and the counts of each filter's effect there, from masked rows; letters name the bits."""
    orders = F.explode(F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")).alias("filter_order")
    steps = rows.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    places = lambda c: [(F.instr("filter_order", x), 1 << i) for i, x in enumerate(c)]
    own = sum((F.when(at == F.col("step"), bit).otherwise(0) for at, bit in places(letters)), F.lit(0))
    before = sum((F.when(at < F.col("step"), bit).otherwise(0) for at, bit in places(letters)), F.lit(0))
    steps = steps.withColumns({"own": own, "before": before})
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    n = lambda where: F.sum(F.when(where, F.col("n")).otherwise(0))
    told = steps.groupBy("part", "filter_order", "step", "own").agg(
        n(~fails & ~gone).alias("kept"),
        n(fails & ~gone).alias("removed"),
        n(fails & gone).alias("redundant"),
        n(F.col("mask") == F.col("own")).alias("unique_fails"),
        n(fails & ~gone & F.col("good")).alias("good_lost"),
        n(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    return told.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(masked(docs, labels)).withColumn("step", F.col("step").cast("int"))
