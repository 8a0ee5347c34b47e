"""Joins along an order against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from sparkreach.operators import andersen, ordered
from sparkreach.sources import binary
from sparkreach.streaming import traces


def rows(df, *c):
    return sorted((tuple(r[x] for x in c) for r in df.collect()), key=repr)


def test_long_ranges(spark):
    """One range of 2 ** 44 places, points at its ends, a range without size, a point without a place."""
    ranges = spark.createDataFrame([(1, 5, 1 << 44), (2, 3, 0), (3, (1 << 62), 1 << 61)], "id bigint, start bigint, size bigint")
    points = spark.createDataFrame([(4,), (5,), ((1 << 44) + 4,), ((1 << 44) + 5,), ((1 << 63) - 1,), (None,)], "at bigint")
    found = dict(rows(ordered.floor_join(points, "at", ranges, "start", "size"), "at", "id"))
    assert found == {4: None, 5: 1, (1 << 44) + 4: 1, (1 << 44) + 5: None, (1 << 63) - 1: None, None: None}
    assert rows(ordered.interval_union(ranges.select("start", (F.col("start") + F.col("size")).alias("end")).where("id < 3"), "start", "end"), "lo", "hi") == [(5, (1 << 44) + 5)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_asof(spark, seed):
    """Ties, busy places, keys, no start before; over several partitions."""
    rng = random.Random(seed)
    starts = [(rng.choice("ab"), rng.randrange(200), i) for i in range(60)]
    points = [(rng.choice("abc"), rng.choice([50, rng.randrange(-20, 220)]), i) for i in range(400)]
    s, p = spark.createDataFrame(starts, "key string, start bigint, id bigint"), spark.createDataFrame(points, "key string, at bigint, n bigint")
    expected = sorted(((k, at, n, max(((x, i) for y, x, i in starts if y == k and x <= at), default=(None, None))[1]) for k, at, n in points), key=repr)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows(ordered.asof(p, "at", s, "start", ["key"]), "key", "at", "n", "id") == expected
        spans = [(k, a, a + rng.randrange(12)) for k, a, _ in starts]
        df = spark.createDataFrame(spans, "key string, lo bigint, hi bigint")
        covered = {(k, x) for k, a, b in spans for x in range(a, b)}
        joined = rows(ordered.interval_union(df, "lo", "hi", ["key"]), "key", "lo", "hi")
        assert {(k, x) for k, a, b in joined for x in range(a, b)} == covered and all(a[0] != b[0] or a[2] < b[1] for a, b in zip(joined, joined[1:]) if a[1] < b[1])
        assert rows(ordered.within(p, "at", df, "lo", "hi", ["key"]), "key", "at", "n") == sorted((x for x in points if x[:2] in covered), key=repr)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def family(rng, lo, hi, depth, out):
    """Intervals that hold each other or are apart; some share an end."""
    out.append((lo, hi))
    at = lo
    while depth and at + 2 < hi:
        end = min(hi, at + rng.randrange(2, 30))
        if rng.random() < 0.7:
            family(rng, at, end, depth - 1, out)
        at = end + rng.choice([0, 0, 3])


@pytest.mark.parametrize("seed", [1, 2])
def test_nested(spark, seed):
    rng, spans = random.Random(seed), []
    for a in range(0, 600, 100):
        family(rng, a, a + rng.choice([60, 100]), 3, spans)
    spans = sorted(set(spans))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)] + [(999, 7, 7)], "id bigint, lo bigint, hi bigint")
    points = spark.range(-5, 620).select(F.col("id").alias("at"))
    for outermost in (False, True):
        found = dict(rows(ordered.nested(points, "at", df, "lo", "hi", outermost), "at", "id"))
        for x in range(-5, 620):
            around = sorted(((b - a, i) for i, (a, b) in enumerate(spans) if a <= x < b), reverse=outermost)
            assert found[x] == (around[0][1] if around else None), x


def test_debug_data(spark):
    """Labels and inlined routines belong to the outermost body; the least address of a function in pieces names it."""
    bodies = spark.createDataFrame([("f", 100, 200), ("f", 20, 40), ("in", 120, 150), ("deep", 125, 130), ("g", 300, 310)], "fn string, low bigint, high bigint")
    labels = spark.createDataFrame([("L_7", 127), ("L_8", 305), ("x_9", 127), ("L_5", 250)], "name string, addr bigint")
    assert rows(binary.label_sites(labels, bodies, "L_"), "fn", "addr", "local") == [("f", 127, 7), ("g", 305, 8)]
    inlined = spark.createDataFrame([("_Zin", 120), ("_Zdeep", 125), ("_Zin", 30), (None, 125), ("_Zlost", 999)], "name string, addr bigint")
    assert rows(binary.inline_edges(inlined, bodies), "inliner", "name") == [(20, "_Zdeep"), (20, "_Zin")]


def test_observed_edges(spark):
    sites = spark.createDataFrame([(10, 65537), (12, 65538)], "addr bigint, node bigint")
    symbols = spark.createDataFrame([(100,), (500,)], "start bigint")
    traced = spark.createDataFrame([(10, 12), (10, 100), (12, 499), (12, 99), (10, 12)], "site bigint, value bigint")
    assert rows(andersen.observed_edges(traced, sites, symbols), "node", "value") == [(65537, 100), (65537, 65538), (65538, 100)]
    with pytest.raises(Exception, match="no trace site"):
        andersen.observed_edges(traced.selectExpr("site + 1 AS site", "value"), sites, symbols).collect()


def test_classify_versions(spark, tmp_path):
    """Two versions of the segments, overlapping segments, freed and reused slots; threads as streams, two batches."""
    segments = spark.createDataFrame([(10, 0, 50), (10, 30, 80), (20, 60, 90)], "since bigint, lo bigint, hi bigint")
    slots = spark.createDataFrame([(100, 16), (116, 16), (40, 30)], "start bigint, size bigint")
    tags = spark.createDataFrame([(100, 5, 7001), (100, 15, None), (100, 18, 7002), (116, 12, 7003), (40, 20, 7004)], "start bigint, since bigint, tag bigint")
    points = [(5, 40), (5, 101), (10, 40), (15, 35), (15, 105), (18, 115), (19, 116), (19, 79), (20, 79), (20, 45), (25, 65), (11, 116), (25, 200)]
    expected = sorted([(5, 101, 7001), (10, 40, 40), (15, 35, 35), (18, 115, 7002), (19, 116, 7003), (19, 79, 79), (20, 79, 79), (20, 45, 7004), (25, 65, 65)], key=repr)
    df = spark.createDataFrame(points, "ts bigint, val bigint")
    assert rows(traces.classify(df, segments, slots, tags), "ts", "val", "as_value") == expected
    for k in range(2):
        df.where(f"val % 2 = {k}").write.parquet(str(tmp_path / f"thread{k}"))
    threads = [spark.readStream.schema(df.schema).parquet(str(tmp_path / f"thread{k}")) for k in range(2)]
    out = str(tmp_path / "out")
    traces.classify_stream(threads, lambda: (segments, slots, tags), out, str(tmp_path / "state")).awaitTermination()
    assert rows(spark.read.parquet(out), "ts", "val", "as_value") == expected
