"""Files of results: functions without a body, reachable functions, slices as DOT, comparisons of two runs.

Each writer writes a folder of parts, in order where the order matters, and has a reader beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import percent_change, with_function_name
from ..functions.nodes import text
from ..operators import graph, reports
from ..operators.ordered import floor_join

UNKNOWN, INVALID = "<unknown>", "<invalid>"


def hexadecimal(x: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(x)))


def address(x: Column) -> Column:
    """The number of a hexadecimal text, with or without 0x; null where it is none."""
    digits = F.regexp_extract(F.trim(x), "^(?:0[xX])?([0-9a-fA-F]{1,16})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).try_cast("bigint"))


# ---- functions without a body


def named(functions: DataFrame, symbols: DataFrame) -> DataFrame:
    """addr, name: of the symbol (addr, name, size) that holds the address, else <unknown>. functions: addr."""
    places = symbols.select(F.col("addr").alias("_start"), "name", "size")
    return floor_join(functions.select("addr"), "addr", places, "_start", "size").select("addr", F.coalesce("name", F.lit(UNKNOWN)).alias("name"))


def write_missing(functions: DataFrame, path: str) -> None:
    """A line a function: its address and name. functions: addr, name."""
    functions.select(F.concat_ws("\t", text(F.col("addr")), "name").alias("value")).write.text(path)


def read_missing(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where("trim(value) <> ''")
    return rows.select(address(parts[0]).alias("addr"), F.get(parts, F.lit(1)).alias("name"))


def missing_report(missing: DataFrame) -> DataFrame:
    """addr, name, function: the name that people write, <invalid> where the mangling is not understood."""
    return with_function_name(missing, "name", "function").withColumn("function", F.coalesce("function", F.lit(INVALID)))


# ---- reachable functions


def write_reachable(functions: DataFrame, path: str) -> None:
    """An address a line; what is no number, as the analysis of another tool may give, is written as it is. functions: node."""
    number = F.col("node").try_cast("bigint")
    functions.select(F.coalesce(hexadecimal(number), F.col("node").cast("string")).alias("value")).write.text(path)


def read_reachable(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(addr of the reachable functions, value of lines that are no address); locals, which have a colon, are in neither."""
    lines = spark.read.text(path).where("NOT contains(value, ':')").withColumn("addr", address(F.col("value")))
    return lines.where("addr IS NOT NULL").select("addr").distinct(), lines.where("addr IS NULL").select("value")


# ---- slices


def slice_lines(calls: DataFrame, names: DataFrame, start: str, end: str) -> DataFrame:
    """pos, line: DOT of the calls on paths between two functions, given and shown by name.

    calls: src, dst, kind, of call sites or functions as texts; names: node, name. Nodes without a name show their address;
    nodes of one name are one.
    """
    of = lambda name: names.where(F.col("name") == name).select("node")
    between = graph.slice_between(graph.collapse(calls), of(start), of(end))
    one = names.groupBy("node").agg(F.min("name").alias("name"))
    shown = between.select("src", "dst")
    for side in ("src", "dst"):
        shown = reports.pretty(F.col(side), one, shown, f"_{side}").drop(side).withColumnRenamed(f"_{side}", side)
    return reports.dot(shown.distinct())


def write_lines(lines: DataFrame, path: str) -> None:
    """lines (pos, line) in order: the parts' names follow it."""
    lines.orderBy("pos", "line").select("line").write.text(path)


# ---- comparisons


def comparison(first: DataFrame, second: DataFrame, metric: str) -> DataFrame:
    """name, first, second, change: a metric of the tests of two runs (name, metrics) and by how many percent of the second the first differs; null where the second lacks the test or has 0."""
    of = lambda run, out: run.select("name", F.col("metrics")[metric].alias(out))
    both = of(first, "first").join(of(second, "second"), "name", "left")
    return both.withColumn("change", percent_change(F.col("first"), F.nullif("second", F.lit(0.0))))


def write_comparison(rows: DataFrame, path: str, first: str, second: str) -> None:
    """CSV with a header that names the runs."""
    titles = ("Testcase", first, second, "Percentage change from n2")
    shown = rows.select(*(F.col(c).alias(t) for c, t in zip(("name", "first", "second", "change"), titles, strict=True)))
    shown.write.option("header", True).csv(path)
