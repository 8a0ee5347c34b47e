"""Reports: call-site tables, DOT, SARIF and code-quality rows, callee summaries, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fingerprint, map_prefix
from ..functions.nodes import normal_symbol

SEVERITY = "critical"


def callsites(calls: DataFrame, instructions: DataFrame, enclosing: DataFrame) -> DataFrame:
    """func, addr, callee. calls: site, callee; instructions: site, addr; enclosing: site, func."""
    return calls.join(instructions, "site").join(enclosing, "site").select("func", "addr", "callee").distinct()


def unplaced(calls: DataFrame, instructions: DataFrame) -> DataFrame:
    """Call sites without an instruction."""
    return calls.select("site").distinct().join(instructions, "site", "left_anti")


def node_instructions(located: DataFrame, lines: DataFrame) -> DataFrame:
    """node, addr for every address of the node's line; last addresses are included. located: node, at; lines: at, first, last."""
    return located.join(lines, "at").select("node", F.explode(F.sequence("first", "last")).alias("addr"))


def callee_summary(graph: DataFrame) -> DataFrame:
    """src, normal, abnormal (sorted names); functions with one normal callee alone are left out. graph: src, dst (text)."""
    kept = lambda c: F.sort_array(F.array_compact(F.collect_set(F.when(c, F.col("dst")))))
    both = graph.groupBy("src").agg(kept(normal_symbol(F.col("dst"))).alias("normal"), kept(~normal_symbol(F.col("dst"))).alias("abnormal"))
    return both.where(~((F.size("normal") == 1) & (F.size("abnormal") == 0)))


def pretty(column: Column, names: DataFrame, rows: DataFrame, out: str) -> DataFrame:
    """rows with the node's name for its text behind stars and dollars. names: node, name."""
    split = rows.withColumn("_stars", F.regexp_extract(column, r"^[*$]*", 0)).withColumn("_core", F.regexp_replace(column, r"^[*$]*", ""))
    return split.join(names.select(F.col("node").alias("_core"), F.col("name").alias("_name")), "_core", "left").withColumn(out, F.concat("_stars", F.coalesce("_name", "_core"))).drop("_stars", "_core", "_name")


def dot(graph: DataFrame) -> DataFrame:
    """line: the statements of a DOT digraph, head and end included, ordered by `pos`."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), '(["\\\\])', r"\\$1"), F.lit('"'))
    body = graph.select(F.lit(1).alias("pos"), F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(";")).alias("line")).distinct()
    ends = graph.sparkSession.createDataFrame([(0, "digraph {"), (2, "}")], "pos int, line string")
    return body.unionByName(ends)


def steps(traces: DataFrame, lines: DataFrame) -> DataFrame:
    """target, pos, addr, is_last, nesting, name, file, line, col, end_line, end_col: located call sites of traces and their last step, numbered again.

    traces: target, pos, addr (callers at even places, their call sites at odd ones); lines: addr, name, file, line, col, end_line, end_col.
    """
    from pyspark.sql import Window

    last = F.max("pos").over(Window.partitionBy("target"))
    kept = traces.withColumn("is_last", F.col("pos") == last).where("pos % 2 = 1 OR is_last")
    number = F.row_number().over(Window.partitionBy("target").orderBy("pos"))
    return kept.join(lines, "addr").select("target", "pos", "addr", "is_last", number.alias("nesting"), "name", "file", "line", "col", "end_line", "end_col")


def closest(traces: DataFrame, lines: DataFrame, inside: bool) -> DataFrame:
    """target, pos, addr, is_last, name, file, line, end_line: the last located step of each trace; with inside, of those in relative files."""
    last = traces.groupBy("target").agg(F.max("pos").alias("last"))
    placed = traces.join(lines, "addr")
    placed = placed.where(~F.col("file").startswith("/")) if inside else placed
    best = placed.groupBy("target").agg(F.max_by(F.struct("pos", "addr", "name", "file", "line", "end_line"), "pos").alias("s")).join(last, "target")
    return best.select("target", "s.pos", "s.addr", (F.col("s.pos") == F.col("last")).alias("is_last"), "s.name", "s.file", "s.line", "s.end_line")


def sarif(results: DataFrame, flows: DataFrame, traces: DataFrame, lines: DataFrame, prefixes: list[tuple[str, str]] | None = None) -> DataFrame:
    """cve_id, result: a SARIF result object as JSON for each vulnerability with a located trace. results: cve_id, classification, justification.

    flows: as from steps, with target the cve_id. The result's location is the closest step in a relative file, else the last located one;
    it is left out where that step is not among the flow's.
    """
    path = map_prefix(F.col("file"), prefixes or [])
    uri = F.when(path.startswith("/"), F.concat(F.lit("file://"), path)).otherwise(path)
    region = F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_col").alias("endColumn"))
    text = F.concat(F.when(F.col("is_last"), "Vulnerable function ").otherwise("Call site in "), "name", F.lit(" (0x"), F.lower(F.hex("addr")), F.lit(")"))
    where = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"), F.struct(text.alias("text")).alias("message"))
    flow = flows.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(where.alias("location"), F.col("nesting").alias("nestingLevel")).alias("step")))).alias("steps"))
    near = closest(traces, lines, True).select("target", F.col("pos").alias("inside")).join(closest(traces, lines, False).select("target", F.col("pos").alias("any")), "target", "right").select("target", F.coalesce("inside", "any").alias("at"))
    locations = F.transform(F.filter("steps", lambda x: x["pos"] == F.col("at")), lambda x: x["step"]["location"])
    code_flows = F.array(F.struct(F.array(F.struct(F.transform("steps", lambda x: x["step"]).alias("locations"))).alias("threadFlows")))
    message = F.concat(F.lit("["), "cve_id", F.lit("] "), F.upper("classification"), F.lit("\n"), "justification", F.lit("."))
    body = F.struct(F.col("cve_id").alias("ruleId"), F.struct(message.alias("text")).alias("message"), F.when(F.size(locations) > 0, locations).alias("locations"), code_flows.alias("codeFlows"))
    found = results.join(flow.withColumnRenamed("target", "cve_id"), "cve_id").join(near.withColumnRenamed("target", "cve_id"), "cve_id")
    return found.select("cve_id", F.to_json(body).alias("result"))


def sarif_log(results: DataFrame) -> DataFrame:
    """pos, line: a SARIF 2.1.0 log of the result objects, a line each between head and end, in order. Results are not gathered in one row."""
    head = '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"sparkreach"}},"results":['
    own = results.groupBy("cve_id", "result").agg(F.count("*").alias("n"))
    first = own.groupBy().agg(F.min(F.struct("cve_id", "result")).alias("f")).select("f.*", F.lit(True).alias("_first"))
    rows = own.join(first, ["cve_id", "result"], "left")
    each = rows.select(F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"), "cve_id", "result", "_first")
    starts = F.coalesce("_first", F.lit(False)) & (F.col("i") == 1)
    body = each.select(F.when(starts, 1).otherwise(2).alias("pos"), F.concat(F.when(starts, "").otherwise(","), "result").alias("line"))
    return body.unionByName(results.sparkSession.createDataFrame([(0, head), (3, "]}]}")], "pos int, line string"))


def fact_graph(edges: DataFrame, names: DataFrame, sub: DataFrame) -> DataFrame:
    """pos, line: DOT of a function's facts. edges: rel, dst, src, idx (null for relations without); names: node, name; sub: dst, src.

    A node is shown by its name, up to " (rnd=", and carries the class of each node above and below it in `sub`, so that a
    viewer can mark these when it is picked; its own class is its id.
    """
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '(["\\\\])', r"\\$1"), F.lit('"'))
    own = lambda c: F.concat(F.lit("class-"), F.regexp_replace(c, r"\W", "_"))
    above = sub.select(F.col("dst").alias("node"), F.concat(F.lit("PARENT"), own(F.col("src"))).alias("c"))
    below = sub.select(F.col("src").alias("node"), F.concat(F.lit("CHILD"), own(F.col("dst"))).alias("c"))
    classes = above.unionByName(below).groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("c")), " ").alias("classes"))
    label = F.substring_index("name", " (rnd=", 1)
    nodes = names.groupBy("node").agg(F.min("name").alias("name")).join(classes, "node", "left")
    shown = F.concat(quoted(F.col("node")), F.lit(" [label="), quoted(label), F.lit(" class="), quoted(F.coalesce("classes", F.lit(""))), F.lit(" id="), quoted(own(F.col("node"))), F.lit("];"))
    text = F.concat("rel", F.coalesce(F.concat(F.lit(" ("), F.col("idx").cast("string"), F.lit(")")), F.lit("")))
    arrow = F.concat(quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.lit(" [label="), quoted(text), F.lit("];"))
    ends = edges.sparkSession.createDataFrame([(0, "digraph {"), (3, "}")], "pos int, line string")
    return ends.unionByName(nodes.select(F.lit(1).alias("pos"), shown.alias("line"))).unionByName(edges.select(F.lit(2).alias("pos"), arrow.alias("line")))


def code_quality(results: DataFrame, traces: DataFrame, lines: DataFrame, inside: bool = False) -> DataFrame:
    """cve_id, fingerprint, row: a code-quality object as JSON for the closest located step of each trace. results: cve_id, classification, justification, function."""
    found = results.join(closest(traces, lines, inside).withColumnRenamed("target", "cve_id"), "cve_id")
    mark = fingerprint("trace-step", F.col("cve_id"), F.col("addr"), F.col("pos"))
    at = F.concat(F.lit("at address 0x"), F.lower(F.hex("addr")))
    step = F.when(F.col("is_last"), F.concat(F.lit("reachable "), at)).otherwise(F.concat(F.lit("reachable from call site in "), "name", F.lit(" "), at))
    text = F.concat(F.lit("["), "cve_id", F.lit("] "), F.upper("classification"), F.lit(" - Vulnerable function "), "function", F.lit(" "), step, F.lit(". "), "justification", F.lit("."))
    body = F.struct(text.alias("description"), mark.alias("fingerprint"), F.lit(SEVERITY).alias("severity"), F.struct(F.col("file").alias("path"), F.struct(F.col("line").alias("begin"), F.col("end_line").alias("end")).alias("lines")).alias("location"))
    return found.select("cve_id", mark.alias("fingerprint"), F.to_json(body).alias("row"))


def results_json(verdicts: DataFrame) -> DataFrame:
    """value: a JSON object a vulnerability."""
    return verdicts.select(F.to_json(F.struct(F.col("cve_id").alias("cve-id"), "classification", "justification")).alias("value"))
