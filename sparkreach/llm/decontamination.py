"""Benchmark decontamination by Wu-Manber multi-pattern search over word sequences.

Patterns are windows of 13 consecutive words of a benchmark item (an item of fewer words is one window). For each
window length there is a shift table over blocks of two words (one word for windows of one word): how far the search
may move on from a position whose last block is that one. A shift of nought leads to a bucket of test windows picked by
the suffix block, then the prefix block, which are compared word by word.

The documents stay where they are read: no shuffle. The benchmark goes out in blocks of about `block_bytes` of text (its
size is taken first, items are dealt by hash); with more than one block, hits are carried in a written table from block
to block. A block's words are numbered, and its tables are arrays over the numbers, made once and broadcast: some 20
bytes for each of its own, so a block of BLOCK_BYTES takes about 200 MB in a worker while it is taken apart and at work
(tests hold it below 400).

Cases: null and empty texts have no words and are not contaminated; texts are searched whole, however long; items
without words have no windows; items with a null id mark words but are not named; rows with equal ids, and equal rows,
are kept apart; an empty table of documents gives no rows, an empty benchmark hits nothing; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, unveiled, veiled, written

WINDOW = 13
BLOCK_BYTES = 8 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Lower-case A-Z; words are runs of digits, a-z and characters beyond ASCII, as UTF-8."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


BLOCK_BITS = np.uint64(32)


def blocks_of(ids: np.ndarray, b: int) -> np.ndarray:
    """The numbers of the blocks of b words (1 or 2) that end at each word but the first b - 1."""
    if b == 1:
        return ids.astype(np.uint64)
    return (ids[:-1].astype(np.uint64) << BLOCK_BITS) | ids[1:].astype(np.uint64)


def each(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all runs from starts, and how far each is from its run's start."""
    far = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(starts, sizes) + far, far


class WuManber:
    """All windows of one length m, as arrays: some 40 bytes a window."""

    def __init__(self, m: int, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, items: np.ndarray):
        """flat: words of all items; starts, sizes: where those of at least m words lie in it; items: their numbers."""
        self.m, self.b, self.flat = m, min(2, m), flat
        self.far = m - self.b + 1
        number = blocks_of(flat, self.b)
        # a block may stand as far on in a window as its item reaches back from it; the furthest place gives the least shift
        at, back = each(starts, sizes - self.b + 1)
        shift = (self.far - 1 - np.minimum(back, self.far - 1)).astype(np.uint8 if m < 256 else np.int32)
        keys = number[at]
        order = np.lexsort((shift, keys))
        keys, shift = keys[order], shift[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        self.blocks, self.shifts = keys[first], shift[first]
        at, _ = each(starts, sizes - m + 1)
        items = np.repeat(items, sizes - m + 1)
        # tests: windows by suffix block, then prefix block
        suffix, prefix = number[at + self.far - 1], number[at]
        order = np.lexsort((prefix, suffix))
        self.suffix, self.prefix, self.at, self.items = suffix[order], prefix[order], at[order].astype(np.int32), items[order]

    def search(self, text: np.ndarray):
        """(first word, numbers of items) of each occurrence. text: numbers of words, 0 for those in no item."""
        m, b = self.m, self.b
        if len(text) < m or not len(self.blocks):
            return
        number = blocks_of(text, b)
        k = np.minimum(np.searchsorted(self.blocks, number), len(self.blocks) - 1)
        move = np.where(self.blocks[k] == number, self.shifts[k], self.far).tolist()
        end, n = m - b, len(move)  # places of blocks
        while end < n:
            step = move[end]
            if step:
                end += step
                continue
            first = end - (m - b)
            lo, hi = np.searchsorted(self.suffix, number[end], "left"), np.searchsorted(self.suffix, number[end], "right")
            lo, hi = lo + np.searchsorted(self.prefix[lo:hi], number[first], "left"), lo + np.searchsorted(self.prefix[lo:hi], number[first], "right")
            for j in range(lo, hi):
                start = self.at[j]
                if np.array_equal(self.flat[start : start + m], text[first : first + m]):
                    yield first, self.items[j]
            end += 1


class Patterns:
    """A block of the benchmark: numbers of its words, its items' names and a matcher for each window length."""

    def __init__(self, rows: Iterable[tuple[str | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str | None] = []
        flat, bounds = array("I"), array("q", [0])
        for name, text in rows:
            w = words(text)
            if w:
                flat.extend(self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w)
                bounds.append(len(flat))
                self.names.append(name)
        flat, bounds = np.frombuffer(flat, np.uint32) if len(flat) else np.zeros(0, np.uint32), np.frombuffer(bounds, np.int64)
        sizes = np.diff(bounds)
        self.matchers = []
        for m in np.unique(np.minimum(sizes, window)).tolist():
            mine = np.flatnonzero(np.minimum(sizes, window) == m)
            self.matchers.append(WuManber(m, flat, bounds[mine], sizes[mine], mine.astype(np.int32)))

    def numbers(self, w: list[bytes]) -> np.ndarray:
        known = self.vocabulary
        return np.fromiter((known.get(x, 0) for x in w), np.uint32, len(w))


def spans(hits: list[int]) -> list[int]:
    """Sorted starts and ends, flat, with overlapping ones joined. hits: starts and ends, flat."""
    out: list[int] = []
    for a, b in sorted(zip(hits[::2], hits[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs' columns `keep` (doc_id, at least) with n_words, hits (word spans, flat) and items (ids as sorted strings)."""
    keep = keep or ["doc_id"]
    bench = benchmark.select("item_id", "text")
    n_bytes = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(n_bytes / block_bytes))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    carried = dict.fromkeys([*keep, "text"])
    state = docs.select(*carried).withColumns({"_hits": F.expr("cast(array() as array<int>)"), "_items": F.expr("cast(array() as array<string>)")})
    for k in range(n_blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).toLocalIterator()
        patterns = docs.sparkSession.sparkContext.broadcast(Patterns(((None if r[0] is None else str(r[0]), r[1]) for r in rows), window))
        last = k == n_blocks - 1
        names = keep if last else list(carried)

        def make(patterns=patterns, names=names, last=last, at=list(carried)):
            found = patterns.value

            def run(*columns):
                texts, hits, named = columns[at.index("text")], columns[-2], columns[-1]
                out_n, out_hits, out_items = [], [], []
                for text, old, ids in zip(texts, hits, named, strict=True):
                    w = words(text)
                    marks, seen, which = list(old), set(ids), set()
                    numbers = found.numbers(w)
                    for m in found.matchers if numbers.any() else ():
                        for first, item in m.search(numbers):
                            marks += (first, first + m.m)
                            which.add(int(item))
                    out_n.append(len(w))
                    out_hits.append(spans(marks))
                    out_items.append(sorted((seen | {found.names[i] for i in which}) - {None}))
                head = [columns[at.index(c)] for c in names]
                return [*head, out_n, out_hits, out_items] if last else [*head, out_hits, out_items]

            return run

        shape = ", ".join(f"`{c}` {kinds[c]}" for c in names)
        if last:
            return map_rows(state, [*carried, "_hits", "_items"], make, f"{shape}, n_words bigint, hits array<int>, items array<string>")
        state = written(map_rows(state, [*carried, "_hits", "_items"], make, f"{shape}, _hits array<int>, _items array<string>"), "hits")
    raise AssertionError("no block")


def n_hit() -> F.Column:
    """Words in `hits`."""
    return F.expr("cast(aggregate(transform(hits, (x, i) -> if(i % 2 = 1, x, -x)), 0, (a, x) -> a + x) as bigint)")


def judged(found: DataFrame) -> DataFrame:
    """With n_hit and contaminated: at least one word in twenty is hit."""
    return found.withColumn("n_hit", n_hit()).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    found = judged(find_contamination(docs, benchmark, **kw))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of docs that are not contaminated."""
    hidden, names = veiled(docs)
    return unveiled(judged(find_contamination(hidden, benchmark, keep=names, **kw)).where(~F.col("contaminated")), docs)
