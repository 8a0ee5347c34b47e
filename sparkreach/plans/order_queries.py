"""Queries of joins along an order, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import andersen, ordered
from ..sources import binary
from .fixtures import fx
from .registry import query


def held(order: str) -> str:
    return f"+p AS (SELECT o_orderkey, addr, fn, row_number() OVER (PARTITION BY o_orderkey ORDER BY {order}) AS k FROM nb_point LEFT JOIN nb_body ON addr >= low AND addr < high) SELECT o_orderkey, addr, fn FROM p WHERE k = 1"


@query(held("high - low"), "nb_point", "nb_body")
def nested_innermost(spark, sf_dir):
    return ordered.nested(fx(spark, sf_dir, "nb_point"), "addr", fx(spark, sf_dir, "nb_body"), "low", "high").select("o_orderkey", "addr", "fn")


@query(held("high - low DESC"), "nb_point", "nb_body")
def nested_outermost(spark, sf_dir):
    return ordered.nested(fx(spark, sf_dir, "nb_point"), "addr", fx(spark, sf_dir, "nb_body"), "low", "high", outermost=True).select("o_orderkey", "addr", "fn")


OUTER = "+p AS (SELECT o_orderkey, addr, fn, low, row_number() OVER (PARTITION BY o_orderkey ORDER BY high - low DESC) AS k FROM nb_point JOIN nb_body ON addr >= low AND addr < high) "


@query(OUTER + "SELECT DISTINCT low AS inliner, concat('_Z', CAST(o_orderkey % 500 AS VARCHAR)) AS name FROM p WHERE k = 1 AND o_orderkey % 4 > 0", "nb_point", "nb_body")
def inline_edges(spark, sf_dir):
    name = F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("_Z"), (F.col("o_orderkey") % 500).cast("string")))
    return binary.inline_edges(fx(spark, sf_dir, "nb_point").select(name.alias("name"), "addr"), fx(spark, sf_dir, "nb_body"))


@query(OUTER + "SELECT fn, addr, CAST(o_orderkey % 9 AS INTEGER) AS local FROM p WHERE k = 1 AND o_orderkey % 2 = 0", "nb_point", "nb_body")
def label_sites(spark, sf_dir):
    name = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("LAB_")).otherwise(F.lit("other_")), (F.col("o_orderkey") % 9).cast("string"))
    return binary.label_sites(fx(spark, sf_dir, "nb_point").select(name.alias("name"), "addr"), fx(spark, sf_dir, "nb_body"), "LAB_")


@query("SELECT o_orderkey, addr, c_custkey, start FROM fx_addr ASOF LEFT JOIN (SELECT c_custkey, c_custkey * 37 + 11 AS start FROM customer) c ON addr >= start", "fx_addr")
def asof_symbols(spark, sf_dir):
    symbols = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (F.col("c_custkey") * 37 + 11).alias("start"))
    return ordered.asof(fx(spark, sf_dir, "fx_addr"), "addr", symbols, "start").select("o_orderkey", "addr", "c_custkey", "start")


@query(
    "+s AS (SELECT s_suppkey * 1000 + 7 AS start FROM supplier) SELECT DISTINCT a.node, coalesce(b.node, (SELECT max(start) FROM s WHERE start <= value)) AS value FROM tv_edge JOIN tv_site a ON a.addr = site LEFT JOIN tv_site b ON b.addr = value WHERE b.node IS NOT NULL OR value >= (SELECT min(start) FROM s)",
    "tv_edge",
    "tv_site",
)
def trace_values(spark, sf_dir):
    symbols = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") * 1000 + 7).alias("start"))
    return andersen.observed_edges(fx(spark, sf_dir, "tv_edge"), fx(spark, sf_dir, "tv_site"), symbols)
