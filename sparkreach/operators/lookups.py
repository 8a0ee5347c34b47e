"""Lookups by key and stream codecs: delta coding, frame slices, keep-first and keep-last. Lookups by address are in `ordered`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def delta_decode(rows: DataFrame, by: list[str], pos: str, delta: str) -> DataFrame:
    """rows with `value`: the running sum of deltas, modulo 2 ** 32."""
    w = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("value", F.sum(delta).over(w).bitwiseAND(F.lit(0xFFFFFFFF)))


def delta_encode(rows: DataFrame, by: list[str], pos: str, value: str) -> DataFrame:
    """rows with `delta`: the difference to the value before, the first to 0."""
    return rows.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(*by).orderBy(pos)), F.lit(0)))


def frame_slices(rows: DataFrame, order: str, size: str, by: list[str]) -> DataFrame:
    """rows with `first`: where each one's slice starts in the array of all."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first", F.coalesce(F.sum(size).over(w), F.lit(0)))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first in order. As an aggregate: nothing is sorted."""
    other = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*other), F.struct(*order)).alias("_row"))
    return first.select(*keys, *(F.col("_row")[c].alias(c) for c in other))


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    other = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*other), F.struct(*order)).alias("_row"))
    return last.select(*keys, *(F.col("_row")[c].alias(c) for c in other))
