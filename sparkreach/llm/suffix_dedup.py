"""Suffix-array dedup: bytes of passages that also start elsewhere, by difference-cover blockwise construction.

Only the order of suffixes up to `WINDOW` = 200 bytes matters: a passage repeats if two suffixes tie that far. Of all
suffixes, those at places of a difference cover (place modulo 133 in COVER) are the sample. Any two places have a shift
below 133 at which both lie in the sample, so two suffixes that tie for 200 bytes have sampled suffixes within them
that tie for 68. First the sample is ranked: prefixes of 68 bytes are sorted one bucket of the key range at a time and
those that tie keep a common rank (their count). A suffix without a tied sample suffix in reach is unique and is never
sorted. The others, a few of all, are sorted bucket by bucket on their whole 200 bytes, and ties there are the repeats.

Prefixes are sorted by 64-bit fingerprint, 48 bits within a bucket and the bucket's own bits beside it; a passage is
removed only if both its sample and its window tie. Texts are packed in blocks of 2 MB; a bucket holds about a million
suffixes, so memory is bounded, and a passage that a third of the rows share is sent once a block. Equal documents are
told apart by digest: all are repeats throughout if they have 200 bytes; of each class one stands for the others
when windows are sorted, and only where its sample ties with more suffixes than its own copies.

Cases: null and empty texts, and those below 200 bytes, keep all bytes; equal rows are copies of each other; matches
never cross documents; ids may be of any type, nulls and repeated ones too; a text of over 2 MB is a block of its own;
an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import MOST, alike, copies, count_keys, expand, members, pack, squeeze, with_answers
from .common import scratch, sha256, written

WINDOW = 200
# fixed values: a perfect difference set modulo 133 (each difference but 0 occurs once)
PERIOD = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
PREFIX = WINDOW - PERIOD + 1

A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * A
    return x ^ (x >> np.uint64(32))


def joined(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
    """Fingerprints of strings whose right part starts shift places on."""
    n = len(right) - shift
    return mixed(left[:n] * B + right[shift:] + np.uint64(shift)) if n > 0 else np.zeros(0, np.uint64)


def fingerprints(data: np.ndarray, size: int) -> np.ndarray:
    """Of all strings of size bytes in data, by joining those of powers of two."""
    powers = [mixed(data.astype(np.uint64) + np.uint64(1))]
    while 2 << (len(powers) - 1) <= size:
        powers.append(joined(powers[-1], powers[-1], 1 << (len(powers) - 1)))
    out, done = None, 0
    for k in reversed(range(len(powers))):
        while size - done >= 1 << k:
            out, done = (powers[k] if out is None else joined(out, powers[k], done)), done + (1 << k)
            if len(out) == 0:
                return out
    return out[: max(0, len(data) - size + 1)]


def ranges(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(place in the block, start, end) of the documents that have a window."""
    ends = np.cumsum(lengths)
    return [(i, int(e) - n, int(e)) for i, (n, e) in enumerate(zip(lengths, ends, strict=True)) if n >= WINDOW]


def sample(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places of the cover's suffixes in the block, and the fingerprints of their prefixes."""
    data = np.frombuffer(expand(row["data"]), np.uint8)
    prints = fingerprints(data, PREFIX)
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    places = [np.flatnonzero(np.resize(inside, e - a - PREFIX + 1)) + a for _, a, e in ranges(row["lengths"])]
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    return at, prints[at]


def windows(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows in the zones, and their fingerprints."""
    data = np.frombuffer(expand(row["data"]), np.uint8)
    at = np.concatenate([np.arange(a, b) for a, b in zip(row["zone_starts"], row["zone_ends"], strict=True)]) if row["zone_starts"] else np.zeros(0, np.int64)
    return at, fingerprints(data, WINDOW)[at]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Places in any [start, end)."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def ties(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each of the keys occurs in all blocks."""
    return counts[np.unique(keys, return_inverse=True)[1]] if len(keys) else counts


def candidates(row: dict, counts: np.ndarray, copied: dict[int, int]) -> dict[str, list]:
    """The block's documents with suffixes near a tied sample, and the zones of these suffixes."""
    out: dict[str, list] = {n: [] for n in ("block", "rids", "lengths", "zone_starts", "zone_ends", "n_windows", "data")}
    at, keys = sample(row)
    many = ties(keys, counts)
    at, many = at[many > 1], many[many > 1]
    data = expand(row["data"])
    rids, lengths, starts, ends, parts, base = [], [], [], [], [], 0
    for i, a, e in ranges(row["lengths"]):
        n = copied.get(i, 1)
        here = slice(np.searchsorted(at, a), np.searchsorted(at, e))
        # more often than its copies; beyond MOST counts are rough, so that many copies go with any tie
        mine = at[here][many[here] > (n if n <= MOST else 1)] - a if n else at[:0]
        if len(mine):
            n = e - a - WINDOW + 1
            x, y = runs(covered(np.minimum(np.maximum(mine - PERIOD + 1, 0), n), np.minimum(mine + 1, n), n))
            rids.append(row["rids"][i])
            lengths.append(e - a)
            starts += (x + base).tolist()
            ends += (y + base).tolist()
            parts.append(data[a:e])
            base += e - a
    if starts:
        for n, v in (("block", row["block"]), ("rids", rids), ("lengths", lengths), ("zone_starts", starts), ("zone_ends", ends), ("n_windows", sum(ends) - sum(starts)), ("data", squeeze(b"".join(parts)))):
            out[n].append(v)
    return out


def removed(row: dict, counts: np.ndarray, _: dict[int, int]) -> dict[str, list]:
    """rid, n_removed, n_spans, kept_sha256, starts, ends of the documents of a block of candidates."""
    at, keys = windows(row)
    at = at[ties(keys, counts) > 1]
    data = expand(row["data"])
    out: dict[str, list] = {n: [] for n in ("rid", "n_removed", "n_spans", "kept_sha256", "starts", "ends")}
    base = 0
    for rid, n in zip(row["rids"], row["lengths"], strict=True):
        mine = at[np.searchsorted(at, base) : np.searchsorted(at, base + n)] - base
        if len(mine):
            x, y = runs(covered(mine, mine + WINDOW, n))
            kept, last = hashlib.sha256(), 0
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                kept.update(data[base + last : base + a])
                last = b
            kept.update(data[base + last : base + n])
            for name, v in (("rid", rid), ("n_removed", int((y - x).sum())), ("n_spans", len(x)), ("kept_sha256", kept.hexdigest()), ("starts", x.tolist()), ("ends", y.tolist())):
                out[name].append(v)
        base += n
    return out


def find_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends (byte spans removed) for each row of docs, written."""
    with scratch(docs.sparkSession):
        return written(found_repeats(docs), "repeats", lasting=True)


def found_repeats(docs: DataFrame) -> DataFrame:
    blocks = pack(docs, lambda t: (sha256(t), len(t)))
    rows = members(blocks)
    same = alike(rows.where(f"length >= {WINDOW}"))
    total = (rows.agg(F.sum("length")).first()[0] or 0) * len(COVER) // PERIOD
    ranked = count_keys(blocks.select("block", "lengths", "data"), lambda row: sample(row)[1], total, 6)
    shape = "block bigint, rids array<bigint>, lengths array<bigint>, zone_starts array<int>, zone_ends array<int>, n_windows bigint, data binary"
    some = written(with_answers(blocks.select("block", "rids", "lengths", "data"), ranked, candidates, shape, copies(rows, same)), "candidates", "none")
    total = some.agg(F.sum("n_windows")).first()[0] or 0
    tied_windows = count_keys(some, lambda row: windows(row)[1], total, 6)
    found = with_answers(some, tied_windows, removed, "rid bigint, n_removed bigint, n_spans bigint, kept_sha256 string, starts array<int>, ends array<int>")
    found = written(found, "repeats")
    whole = same.select("mark", F.lit(True).alias("copied"))
    joined = rows.join(whole, "mark", "left").join(found, "rid", "left")
    either = lambda copied, other, none: F.when(F.col("copied") & (F.col("length") >= WINDOW), copied).otherwise(F.coalesce(other, none))
    empty = F.array().cast("array<int>")
    return joined.select(
        "doc_id",
        F.col("length").alias("n_bytes"),
        either(F.col("length"), F.col("n_removed"), F.lit(0).cast("bigint")).alias("n_removed"),
        either(F.lit(1).cast("bigint"), F.col("n_spans"), F.lit(0).cast("bigint")).alias("n_spans"),
        either(F.lit(sha256(b"")), F.col("kept_sha256"), F.col("mark")).alias("kept_sha256"),
        either(F.array(F.lit(0)), F.col("starts"), empty).alias("starts"),
        either(F.array(F.col("length").cast("int")), F.col("ends"), empty).alias("ends"),
    )


def report(docs: DataFrame) -> DataFrame:
    return find_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
