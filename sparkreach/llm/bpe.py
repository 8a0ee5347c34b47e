"""Byte-level BPE: encoding folds ranked merges over distinct words with higher-order functions, decoding joins pieces.

Texts are split by the tokenizer's pattern. Words that are tokens themselves need no merges. Of the others, every
distinct one is folded: its bytes (as the ids of their tokens) are an array, and aggregate() merges, step by step, the
adjacent pair of lowest rank, leftmost first. The ranks are a literal, an array of small maps from pairs of ids to the
id of their concatenation (which is its rank); a pair's number picks the map, as Spark looks through a map from its
start. The vocabulary is of fixed size, whatever the corpus.

Occurrences are not joined to the dictionary. Documents are taken in blocks of about BLOCK bytes, written once: a block
keeps its texts as numbers of its distinct words, and sends each bucket the words that it needs, sorted, as one binary
value. A bucket's distinct words are folded in one row, and each block gets the ids of its own words back, in its order.
Blocks are a table bucketed by block, so they meet their answers where they lie and are not shuffled. They are dealt
into slices of SLICE, each with its own buckets, so that a word that stands in every block of a corpus of any size is
met by SLICE blocks at most, and rows sent are never more than words sent. Words over LONG bytes (runs without a break)
are merged in the task with a heap, as a fold's cost grows with the square of the length.

Cases: null and empty texts have no tokens; equal or null ids are kept apart, ids may be of any type; a text longer
than a block is one of its own; an empty table gives no rows; further columns are ignored; special tokens do not exist,
their text is text.
"""

from __future__ import annotations

import base64
import contextlib
import heapq
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import expand, squeeze
from .common import bucketed, scratch, sha256, written

BLOCK, BUCKET = 6 << 20, 4 << 20  # bytes of text
SLICE = 4096  # blocks that share buckets
LONG = 255
SHARDS = 16381  # a prime


def vocabulary(path: str) -> dict[bytes, int]:
    """Token to rank, from a file of base 64 and rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}


# ---- words


def ascii_only(pattern: str) -> Callable[[str], list[str]] | None:
    """findall of the pattern on ASCII texts by re, which takes half of regex's time; None if the pattern has more than literals, classes, \\s, \\S, \\p{L} and \\p{N}."""
    parts = regex.findall(r"\\p\{[LN]\}|\\.|[+*?}]\+|\(\?[!=:]?|.", pattern, regex.S)
    listed = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r\x20", r"\S": ""}
    out, inside = [], False
    for x in parts:
        if x == r"\S" and not inside:
            out.append(r"[^\t-\r\x20]")
        elif listed.get(x):
            out.append(listed[x] if inside else f"[{listed[x]}]")
        elif len(x) > 1 and x not in (r"\r", r"\n", r"\t", "(?!", "(?=", "(?:") or x == "(" or inside and x in "[&|~-":
            return None
        else:
            inside = x == "[" or inside and x != "]"
            out.append(x)
    return re.compile("".join(out)).findall


@lru_cache(2)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    every, plain = regex.compile(pattern).findall, ascii_only(pattern)
    return (lambda text: plain(text) if text.isascii() else every(text)) if plain else every


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap and links, for words too long to fold."""
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, end = heapq.heappop(heap)
        if ends[i] < 0 or ends[i] == n or ends[ends[i]] != end:
            continue  # one of the two has changed
        right = ends[i]
        ends[i], ends[right] = end, -1
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


def end_of(ranks: dict[bytes, int]) -> int:
    """A power of two above all ids. In a fold, ids are above it and ranks below."""
    return 1 << max(ranks.values(), default=0).bit_length()


def rank_literal(ranks: dict[bytes, int]) -> F.Column:
    """array<map<pair, id>>, by the pair's number modulo SHARDS; folded to a literal when the plan is made. Needs Spark's default, ANSI casts."""
    shards: list[list[str]] = [[] for _ in range(SHARDS)]
    end = end_of(ranks)
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                shards[(a * end + b) % SHARDS].append(f'"{a * end + b}":{rank}')
    # JSON has no keys but strings
    return F.from_json(F.lit("[" + ",".join("{" + ",".join(x) + "}" for x in shards) + "]"), "array<map<string,int>>").cast("array<map<bigint,int>>")


def started(words: list[bytes], byte_ids: np.ndarray, pair_ranks: np.ndarray, end: int) -> pa.ListArray:
    """Words as folds take them: end, null, then the id (above end) of each byte with its rank with the next one between, null, end."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(2 * sizes + 3)
    every = np.frombuffer(b"".join(words), np.uint8)
    at = np.arange(len(every)) * 2 + np.repeat(np.arange(len(words)) * 3, sizes) + 2
    flat, known = np.full(int(ends[-1]) if len(words) else 0, end, np.int32), np.ones(int(ends[-1]) if len(words) else 0, bool)
    flat[at] = byte_ids[every] + end + 1
    ranks = np.append(pair_ranks[every[:-1], every[1:]], -1) if len(every) else np.zeros(0, np.int32)
    ranks[np.cumsum(sizes) - 1] = -1
    flat[at + 1], known[at + 1] = ranks, ranks >= 0
    known[ends - 2 * sizes - 2] = False
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat, mask=~known))


def fold(word: F.Column, table: F.Column, end: int) -> F.Column:
    """ids of a word of two bytes or more, as started makes it."""

    def rank(a: F.Column, b: F.Column) -> F.Column:
        pair = a.cast("bigint") * end + b
        return F.try_element_at(F.get(table, (pair % SHARDS).cast("int")), pair)

    def step(acc: F.Column, _: F.Column) -> F.Column:
        def merge(best: F.Column) -> F.Column:
            i = F.array_position(acc, best).cast("int")  # of the lowest rank, the leftmost; its pair stands around it
            before, after = F.element_at(acc, i - 3) - (end + 1), F.element_at(acc, i + 3) - (end + 1)  # -1 at the ends: no pair
            middle = F.array(rank(before, best), best + (end + 1), rank(best, after))
            return F.flatten(F.array(F.slice(acc, F.lit(1), i - 3), middle, F.slice(acc, i + 3, F.size(acc))))

        # a transform over an array of one binds the lowest rank, so that it is found once
        return F.element_at(F.transform(F.array(F.array_min(acc)), lambda x: F.when(x < end, merge(x)).otherwise(acc)), 1)

    merged = F.aggregate(F.sequence(F.lit(3), F.size(word), F.lit(2)), word, step)
    return F.transform(F.filter(merged, lambda x: x > end), lambda x: x - (end + 1))


# ---- blocks


class Block:
    """Texts as numbers of distinct words, in the order in which they are met."""

    def __init__(self, number: int):
        self.number, self.ids, self.lengths, self.texts, self.size = number, [], [], [], 0
        self.words = defaultdict(count().__next__)  # a new word takes the next number as it is looked up

    def add(self, doc_id, text: str, split: Callable[[str], list[str]]) -> None:
        pieces = split(text)
        self.ids.append(doc_id)
        self.texts.append(np.fromiter(map(self.words.__getitem__, pieces), np.int32, len(pieces)))
        self.lengths.append(len(text.encode("utf-8", "surrogatepass")))
        self.size += self.lengths[-1] + 64


def blocks_of(batches: Iterator[pa.RecordBatch], split: Callable[[str], list[str]]) -> Iterator[Block]:
    """The task's rows in blocks."""
    block = Block(TaskContext.get().partitionId() << 20)
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            block.add(doc_id, text.as_py() or "", split)
            if block.size >= BLOCK:
                yield block
                block = Block(block.number + 1)
    if block.ids:
        yield block


def bucket_of(words: list[bytes], n: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.uint32, len(words)) % n


def framed(words: list[bytes]) -> bytes:
    """Sorted words: what each shares with the one before, its length beyond that, and the rest."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.array(words, f"S{LONG + 1}").view(np.uint8).reshape(len(words), -1)
    same = np.minimum(np.argmin(chars[1:] == chars[:-1], axis=1), np.minimum(sizes[1:], sizes[:-1])) if len(words) > 1 else np.zeros(0, np.int64)
    shared = np.concatenate(([0], same))
    return squeeze(shared.astype(np.uint8).tobytes() + (sizes - shared).astype(np.uint8).tobytes() + b"".join(w[k:] for w, k in zip(words, shared.tolist(), strict=True)))


def unframed(data: bytes, n: int) -> list[bytes]:
    raw, out, before, at = expand(data), [], b"", 2 * n
    for k, m in zip(raw[:n], raw[n : 2 * n], strict=True):
        before = before[:k] + raw[at : at + m]
        at += m
        out.append(before)
    return out


def planes(x: np.ndarray) -> bytes:
    """Numbers of 32 bits by byte of them, which compress better."""
    return squeeze(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def ragged(flat: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[lo:lo + size] of each, one after the other."""
    return flat[np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())] if len(size) else flat[:0]


def described(block: Block, vocab: dict[bytes, int], n_buckets: int) -> list[dict]:
    """The block's rows: its texts, and what it asks of each bucket."""
    every = np.concatenate([*block.texts, np.zeros(0, np.int32)])
    order = np.argsort(-np.bincount(every, minlength=len(block.words)), kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    told, asked = [], {}
    for i, x in zip(place.tolist(), block.words, strict=True):
        w = x.encode("utf-8", "surrogatepass")
        if (known := vocab.get(w)) is not None:
            told.append([i, 1, known])
        elif len(w) > LONG:
            ids = merge_long(w, vocab)
            told.append([i, len(ids), *ids])
        else:
            asked[w] = i
    asked_words = sorted(asked)
    numbers = np.fromiter(map(asked.__getitem__, asked_words), np.int64, len(asked))
    at = bucket_of(asked_words, n_buckets)
    by = np.argsort(at, kind="stable")
    own = np.array([len(told), *(x[0] for x in told), *(x[1] for x in told), *(y for x in told for y in x[2:])], np.int64)
    rows = [{"block": block.number, "doc_ids": block.ids, "lengths": block.lengths, "sizes": [len(t) for t in block.texts], "texts": planes(place[every]), "known": planes(own), "at": planes(numbers[by])}]
    bounds = np.flatnonzero(np.diff(at[by], prepend=-1, append=n_buckets)).tolist() if asked else [0]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        rows.append({"block": block.number, "bucket": int(at[by[a]]), "n": b - a, "words": framed([asked_words[i] for i in by[a:b].tolist()])})
    return rows


def blocks_table(docs: DataFrame, ranks, pattern: str, n_buckets: int) -> DataFrame:
    """Rows of two kinds: block, bucket, n, words that the block asks for; and block, doc_ids, lengths (bytes),
    sizes (words), texts (numbers of words, commonest first), known (number of words that need no bucket, their numbers, numbers of ids, ids),
    at (numbers of the words asked for, in order of bucket and word)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"block bigint, bucket int, n int, words binary, doc_ids array<{kind}>, lengths array<int>, sizes array<int>, texts binary, known binary, at binary"
    out = to_arrow_schema(T.StructType.fromDDL(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, splitter(pattern)):
            yield pa.RecordBatch.from_pylist(described(block, ranks.value, n_buckets), schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, shape)


@contextlib.contextmanager
def short_plans(spark: SparkSession) -> Iterator[None]:
    """Plans are described in few characters: the driver keeps descriptions, and the literal has millions of them."""
    key = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def dictionary(sent: DataFrame, vocab: dict[bytes, int]) -> DataFrame:
    """Written: blocks (block, bucket, and the ranks of its words in the bucket) and ids of the bucket's distinct words, a row for each bucket of a slice."""
    end = end_of(vocab)
    byte_ids = np.array([vocab[bytes([i])] for i in range(256)], np.int32)
    pair_ranks = np.array([[vocab.get(bytes([i, j]), -1) for j in range(256)] for i in range(256)], np.int32)
    shape = "blocks array<struct<block:bigint,bucket:int,n:int,ranks:binary>>, words array<array<int>>"
    out = to_arrow_schema(T.StructType.fromDDL(shape))

    def ranked(rows: pa.Table) -> pa.Table:
        held = [unframed(x.as_py(), n.as_py()) for x, n in zip(rows.column("words"), rows.column("n"), strict=True)]
        words = sorted(set().union(*held))
        place = {w: i for i, w in enumerate(words)}
        given = rows.select(["block", "bucket", "n"]).to_pylist()
        for x, own in zip(given, held, strict=True):
            x["ranks"] = planes(np.diff(np.fromiter(map(place.__getitem__, own), np.int64, len(own)), prepend=0))
        every = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), started(words, byte_ids, pair_ranks, end))
        return pa.table([pa.array([given], out.types[0]), every.cast(out.types[1])], schema=out)

    rows = sent.groupBy("slice", "bucket").applyInArrow(ranked, shape)
    with short_plans(sent.sparkSession):
        # bound by a transform over an array of one, so that the plan has the literal once
        ids = F.element_at(F.transform(F.array(rank_literal(vocab)), lambda table: F.transform("words", lambda w: fold(w, table, end))), 1)
        return written(rows.select("blocks", ids.alias("ids")), "dictionary")


def answers(told: DataFrame) -> DataFrame:
    """block, bucket, n, ids: numbers of ids, then the ids of a block's n words in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for given, found in zip(b.column(0), b.column(1), strict=True):
                ids = found.values
                flat, bounds = ids.flatten().to_numpy(), ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py()
                rows = given.as_py()
                for x in rows:
                    at = np.cumsum(from_planes(x.pop("ranks")), dtype=np.int64)
                    lo, size = bounds[at], bounds[at + 1] - bounds[at]
                    x["ids"] = planes(np.concatenate((size, ragged(flat, lo, size))))
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    shape = "block bigint, bucket int, n int, ids binary"
    out = to_arrow_schema(T.StructType.fromDDL(shape))
    return told.mapInArrow(run, shape)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_bytes, ids (little-endian unsigned 32-bit) for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return encoded(docs, path, pattern, lambda lengths, ids: [lengths, ids], f"doc_id {kind}, n_bytes bigint, ids binary")


def spelled(row: dict, found: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of the block's words, and where those of each word are: first, number."""
    own = from_planes(row["known"])
    m = int(own[0])
    place, sizes, parts = [own[1 : m + 1], from_planes(row["at"])], [own[m + 1 : 2 * m + 1]], [own[2 * m + 1 :]]
    for x in sorted(found, key=lambda x: x["bucket"]):
        raw = from_planes(x["ids"])
        sizes.append(raw[: x["n"]])
        parts.append(raw[x["n"] :])
    order, size = np.argsort(np.concatenate(place)), np.concatenate(sizes).astype(np.int64)
    return np.concatenate(parts), (np.cumsum(size) - size)[order], size[order]


def encoded(docs: DataFrame, path: str, pattern: str, finish: Callable[[list, list], list[list]], schema: str) -> DataFrame:
    """doc_id, and what finish makes of each block's lengths in bytes and ids, written."""
    vocab = vocabulary(path)
    ranks = docs.sparkSession.sparkContext.broadcast(vocab)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_slices = max(1, -(-size // (SLICE * BLOCK)))
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        flat, lo, size = spelled(row, found.to_pylist())
        words, ids, start = from_planes(row["texts"]), [], 0
        for m in row["sizes"]:
            mine = words[start : start + m]
            ids.append(ragged(flat, lo[mine], size[mine]).tobytes())
            start += m
        got = [row["doc_ids"], *finish(row["lengths"], ids)]
        return pa.table([pa.array(c, t) for c, t in zip(got, out.types, strict=True)], schema=out)

    table = blocks_table(docs, ranks, pattern, max(1, -(-size // (n_slices * BUCKET))))
    with scratch(docs.sparkSession), bucketed(table, "bpe", "block", max(1, -(-size // (4 * BLOCK)))) as blocks:
        sent = blocks.where("bucket IS NOT NULL").select(F.pmod(F.xxhash64("block"), F.lit(n_slices)).alias("slice"), "bucket", "block", "n", "words")
        told = answers(dictionary(sent, vocab))
        texts = blocks.where("bucket IS NULL").select("block", "doc_ids", "lengths", "sizes", "texts", "known", "at")
        found = written(texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema), "encoded", lasting=True)
    ranks.unpersist()
    return found


def joined(ids: bytes, piece: dict[int, bytes]) -> bytes:
    """The binary pieces of ids, concatenated."""
    return b"".join(map(piece.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows with `decoded`: what their ids stand for."""
    pieces = rows.sparkSession.sparkContext.broadcast({r: t for t, r in vocabulary(path).items()})
    names = [c for c in rows.columns if c != "ids"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(len(names))
            some = [joined(x.as_py(), pieces.value) for x in raw]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), raw, pa.array(some, pa.binary())], names=[*names, "ids", "decoded"])

    return rows.select(*names, "ids").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", ids binary, decoded binary")


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs; encoded, decoded and digested in one task each."""
    pieces = docs.sparkSession.sparkContext.broadcast({r: t for t, r in vocabulary(path).items()})
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(_: list, ids: list) -> list[list]:
        piece = pieces.value
        return [[len(x) // 4 for x in ids], [sha256(x) for x in ids], [sha256(joined(x, piece)) for x in ids]]

    return encoded(docs, path, pattern, finish, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
