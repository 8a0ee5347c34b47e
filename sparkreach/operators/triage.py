"""Triage: vulnerabilities to functions, and verdicts from reachability.

vulns: cve_id, component, version_range, fname_pattern (LIKE); functions: sym, fname, component, version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import function_name
from ..functions.versions import parse, satisfies
from ..storage import written
from .fixpoint import union
from .graph import through

UNREACHABLE, POSSIBLE, REACHABLE, UNKNOWN = "unreachable", "potentially reachable", "reachable", "unassessable"
# fixed values: which verdict wins when a vulnerability has several functions
RANK = {UNREACHABLE: 0, UNKNOWN: 1, POSSIBLE: 2, REACHABLE: 3}


def versions_in_range(vulns: DataFrame, functions: DataFrame) -> DataFrame:
    """cve_id, sym, fname, fname_pattern: functions of the vulnerable component in a vulnerable version.

    Ranges are checked once for each distinct version of a component, then joined to functions by both.
    """
    known = functions.select("component", "version").distinct()
    hit = vulns.join(known, "component").where(parse(F.col("version")).isNotNull()).where(satisfies(F.col("version"), F.col("version_range")))
    return hit.join(functions, ["component", "version"]).select("cve_id", "sym", "fname", "fname_pattern", "component", "version")


def match(vulns: DataFrame, functions: DataFrame, inlined: DataFrame | None = None) -> DataFrame:
    """cve_id, sym, fname of the functions that the vulnerabilities name, by raw or short name; inlined (sym, name): functions with such a body in them count as well."""
    found = versions_in_range(vulns, functions)
    direct = found.where(F.expr("fname LIKE fname_pattern") | F.expr("fname_pattern = fname") | (function_name(F.col("fname")) == F.col("fname_pattern")))
    out = direct.select("cve_id", "sym", "fname")
    if inlined is not None:
        inner = found.join(inlined, "sym").where(F.expr("name LIKE fname_pattern") | (function_name(F.col("name")) == F.col("fname_pattern")))
        out = out.unionByName(inner.select("cve_id", "sym", "fname"))
    return out.distinct()


# ---- filters: targets (cve_id, sym, fname) to targets with verdict and note; null leaves them to the next

Filter = Callable[[DataFrame], DataFrame]


def address_set(reached: DataFrame) -> Filter:
    """Functions outside the reachable set are unreachable."""

    def run(targets: DataFrame) -> DataFrame:
        r = reached.select(F.col("node").alias("sym"), F.lit(True).alias("_in"))
        return targets.join(r, "sym", "left").select(*targets.columns, F.when(F.col("_in").isNull(), UNREACHABLE).alias("verdict"), F.when(F.col("_in").isNull(), F.concat("fname", F.lit(" is not reachable from the program's entry"))).alias("note"))

    return run


def required_symbols(required: DataFrame, names: DataFrame, reached: DataFrame) -> Filter:
    """required: cve_id, name. A vulnerability is unreachable unless all further symbols are reached. names: sym, fname."""

    def run(targets: DataFrame) -> DataFrame:
        there = names.join(reached.select(F.col("node").alias("sym")), "sym", "left_semi").select(F.col("fname").alias("name")).distinct()
        lost = required.join(there, "name", "left_anti").groupBy("cve_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("_lost"))
        return targets.join(lost, "cve_id", "left").select(*targets.columns, F.when(F.col("_lost").isNotNull(), UNREACHABLE).alias("verdict"), F.when(F.col("_lost").isNotNull(), F.concat(F.lit("not reachable, but required: "), "_lost")).alias("note"))

    return run


def waypoints(calls: DataFrame, start: DataFrame, way: DataFrame, names: DataFrame) -> Filter:
    """way: cve_id, pos, name of the waypoints that a path from start (node) has to pass in order. names: sym, fname. One search for all vulnerabilities.

    A target whose waypoints are not all in the program is unreachable, and so is one without a path through them; the
    note then names another path, if there is one. A path is told as a note without a verdict.
    """

    def run(targets: DataFrame) -> DataFrame:
        begin = start.agg(F.min("node")).first()[0]
        symbol = names.groupBy(F.col("fname").alias("name")).agg(F.min("sym").alias("node"))
        placed = written(way.join(symbol, "name", "left").select("cve_id", F.col("pos").cast("bigint").alias("pos"), "name", "node"), "waypoints")
        named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), ", ")
        lost = placed.groupBy("cve_id").agg(F.min_by("name", F.when(F.col("node").isNull(), F.col("pos"))).alias("_lost"), named.alias("_way"))
        mine = written(targets.select("cve_id", "sym").distinct().withColumn("request", F.concat_ws(">", "cve_id", F.col("sym").cast("string"))), "requests")
        straight = F.concat(F.lit("straight>"), F.col("request"))  # the same targets without waypoints, for those that miss their way
        both = union([mine.select("request", "sym"), mine.select(straight.alias("request"), "sym")])
        ends = both.select("request", F.inline(F.array(F.struct(F.lit(-1).cast("bigint").alias("pos"), F.lit(begin).cast(names.schema["sym"].dataType).alias("node")), F.struct(F.lit(1 << 40).alias("pos"), F.col("sym").alias("node")))))
        inner = mine.join(placed, "cve_id").select("request", "pos", "node")
        found = through(calls, ends.unionByName(inner))
        name = names.select(F.col("sym").alias("node"), "fname")
        steps = found.join(name, "node", "left").withColumn("fname", F.coalesce("fname", F.col("node").cast("string"))).where("pos > 0 OR leg = 0")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leg", "pos", "fname"))), lambda x: x["fname"]), " > ")
        told = written(steps.groupBy("request").agg(text.alias("path")), "paths")
        whole = told.select("request", F.col("path").alias("_path"))
        other = told.where(F.col("request").startswith("straight>")).select(F.expr("substring(request, 10)").alias("request"), F.col("path").alias("_other"))
        judged = mine.join(whole, "request", "left").join(other, "request", "left").join(lost, "cve_id", "left").drop("request")
        out = targets.join(judged, ["cve_id", "sym"], "left")
        bad = F.col("_lost").isNotNull() | F.col("_path").isNull()
        note = F.when(F.col("_lost").isNotNull(), F.concat("fname", F.lit(" needs a waypoint that is not in the program: "), "_lost")).when(F.col("_path").isNotNull(), F.concat(F.lit("path: "), "_path"))
        note = note.otherwise(F.concat("fname", F.lit(" has no path through "), F.coalesce("_way", F.lit("the call graph")), F.coalesce(F.concat(F.lit("; another path: "), "_other"), F.lit(""))))
        return out.select(*targets.columns, F.when(bad, UNREACHABLE).alias("verdict"), note.alias("note"))

    return run


def apply(targets: DataFrame, filters: list[Filter]) -> DataFrame:
    """targets with the first verdict that a filter gives and all notes; potentially reachable without any."""
    out = targets.withColumn("_v", F.lit(None).cast("string")).withColumn("_n", F.array().cast("array<string>"))
    for f in filters:
        out = f(out).select(*targets.columns, F.coalesce("_v", "verdict").alias("_v"), F.when(F.col("_v").isNull() & F.col("note").isNotNull(), F.concat("_n", F.array("note"))).otherwise(F.col("_n")).alias("_n"))
    return out.select(*targets.columns, F.coalesce("_v", F.lit(POSSIBLE)).alias("verdict"), F.array_join("_n", "; ").alias("note"))


def merge(vulns: DataFrame, judged: DataFrame) -> DataFrame:
    """cve_id, classification, n_targets, n_reachable, address, justification: the strongest verdict of a vulnerability's functions, the first function (by address) that has it if it may be reached, and their notes by address."""
    rank = F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))
    rows = judged.withColumn("_r", rank[F.col("verdict")])
    some = rows.groupBy("cve_id").agg(F.max(F.struct("_r", "verdict")).alias("_best"), F.count("*").alias("n_targets"), F.sum((F.col("verdict") != UNREACHABLE).cast("bigint")).alias("n_reachable"), F.collect_list(F.struct("sym", "_r", "note")).alias("_notes"))
    best = F.array_sort(F.filter("_notes", lambda x: x["_r"] == F.col("_best")["_r"]))
    told = F.array_join(F.transform(F.filter(best, lambda x: x["note"] != ""), lambda x: x["note"]), "; ")
    return vulns.select("cve_id").distinct().join(some, "cve_id", "left").select(
        "cve_id",
        F.coalesce(F.col("_best")["verdict"], F.lit(UNREACHABLE)).alias("classification"),
        F.coalesce("n_targets", F.lit(0)).cast("bigint").alias("n_targets"),
        F.coalesce("n_reachable", F.lit(0)).cast("bigint").alias("n_reachable"),
        F.when(F.col("_best")["verdict"] != UNREACHABLE, F.try_element_at(best, F.lit(1))["sym"]).alias("address"),
        F.when(F.col("_best").isNull(), F.lit("no function of the vulnerable component and version")).otherwise(told).alias("justification"),
    )


def run(vulns: DataFrame, functions: DataFrame, reached: DataFrame, filters: list[Filter] | None = None, inlined: DataFrame | None = None) -> DataFrame:
    return merge(vulns, apply(match(vulns, functions, inlined), [address_set(reached), *(filters or [])]))


def to_analyse(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results that a closer analysis can take up: possibly reachable, with an address; the others, as they are). results: classification, address."""
    open_ = ~F.coalesce(F.col("classification").isin(UNREACHABLE, UNKNOWN), F.lit(False)) & F.col("address").isNotNull()
    return results.where(open_), results.where(~open_)
