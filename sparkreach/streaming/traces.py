"""Trace streams: keep-first dedup of (site, value), value classification, and windowed counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.nodes import clear_epoch
from ..operators.fixpoint import union
from ..operators.ordered import asof, floor_join, interval_union
from ..storage import shared_dir, written


def distinct_edges(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """The first of each (site, val); state grows with the edges, or is dropped after `watermark` on ts."""
    masked = stream.withColumn("site", clear_epoch(F.col("site"))).where("site <> 0")
    if watermark:
        return masked.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["site", "val"])
    return masked.dropDuplicates(["site", "val"])


def classify(values: DataFrame, segments: DataFrame, slots: DataFrame, tags: DataFrame) -> DataFrame:
    """values (ts, val, ...) with `as_value`, one row a value at most: itself in a segment, else the tag of its allocation; others are dropped.

    segments: since, lo, hi, a whole set for each `since`, in force until the next one. slots: start, size, apart from each
    other. tags: start (of a slot), since, tag (null once freed). What was in force at the value's ts counts.
    """
    version = segments.select(F.col("since").alias("_version")).distinct()
    seen = asof(values, "ts", version, "_version")
    keyed = written(seen, "values")
    own = interval_union(segments.select(F.col("since").alias("_version"), "lo", "hi"), "lo", "hi", ["_version"])
    placed = asof(keyed.where("_version IS NOT NULL"), "val", own, "lo", ["_version"])
    inside = placed.withColumn("_in", F.coalesce(F.col("val") < F.col("hi"), F.lit(False))).select(*values.columns, "_in")
    inside = written(inside.unionByName(keyed.where("_version IS NULL").select(*values.columns, F.lit(False).alias("_in"))), "placed")
    there = floor_join(inside.where("NOT _in").drop("_in"), "val", slots.select(F.col("start").alias("_slot"), "size"), "_slot", "size").where("_slot IS NOT NULL")
    tagged = asof(there.drop("size"), "ts", tags.select(F.col("start").alias("_slot"), F.col("since").alias("_since"), F.col("tag").alias("_tag")), "_since", ["_slot"])
    return inside.where("_in").select(*values.columns, F.col("val").alias("as_value")).unionByName(tagged.where("_tag IS NOT NULL").select(*values.columns, F.col("_tag").alias("as_value")))


def classify_stream(threads: list[DataFrame], tables: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], out: str, checkpoint: str) -> StreamingQuery:
    """Classifies the union of the threads' streams (ts, val, ...), batch by batch, into a table at out; tables gives segments, slots and tags as they are when a batch begins."""

    def batch(rows: DataFrame, number: int) -> None:
        found = classify(written(rows, "batch"), *tables())
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is run again replaces itself

    return union(threads).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def words(buffers: DataFrame) -> DataFrame:
    """site, val of every whole 8-byte little-endian word of buffers (site, data)."""
    n = F.floor(F.octet_length("data") / 8).cast("int")
    at = buffers.where(F.octet_length("data") >= 8).select("site", "data", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    part = F.expr("substring(data, i * 8 + 1, 8)")
    return at.select("site", F.conv(F.array_join(F.reverse(F.regexp_extract_all(F.hex(part), F.lit("(..)"), F.lit(1))), ""), 16, 10).cast("decimal(20,0)").alias("val"))


def dedup_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events table read as a stream to its end; distinct (site, val) as a table."""
    events = spark.read.parquet(path).select("event_id", "user_id")
    stream = spark.readStream.schema(events.schema).parquet(f"{path}*")
    found = distinct_edges(stream.select(((F.col("user_id") + 1) * 2 + F.col("event_id") % 2).alias("site"), (F.col("event_id") % 50).alias("val")))
    out = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    run = found.writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("site bigint, val bigint").parquet(f"{out}/table")
