"""Sources and sinks: facts of the test tables written in each format, read back, and held against SQL over the tables."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.nodes import text
from ..operators import reports
from ..sources import binary, facts, folders, frames
from ..storage import new_path
from ..streaming import traces
from .fixtures import fx
from .registry import query


@query("SELECT DISTINCT concat('0x', lpad(lower(to_hex(dst)), 16, '0')) AS \"to\", concat('0x', lpad(lower(to_hex(src)), 16, '0')) AS \"from\" FROM fx_assign", "fx_assign")
def src_relation(spark, sf_dir):
    path = new_path(spark, "relation")
    facts.write_relation(fx(spark, sf_dir, "fx_assign").select(text(F.col("dst")).alias("to"), text(F.col("src")).alias("from")), path)
    return facts.read_relation(spark, path, "Assign")


@query("SELECT DISTINCT concat('0x', lpad(lower(to_hex(dst)), 16, '0')) AS \"to\", concat('0x', lpad(lower(to_hex(src)), 16, '0')) AS \"from\" FROM fx_store", "fx_store")
def src_relation_gzip(spark, sf_dir):
    path = new_path(spark, "relation")
    fx(spark, sf_dir, "fx_store").select(text(F.col("dst")), text(F.col("src"))).write.option("sep", "\t").option("compression", "gzip").csv(path)
    return facts.read_gzip_sniffed(spark, path, "Store")


@query("SELECT sym, CAST(sym AS BIGINT) AS symbol, CAST(CASE WHEN sym % 3 = 0 THEN sym % 100 END AS INTEGER) AS local FROM fx_fn", "fx_fn")
def src_typed_nodes(spark, sf_dir):
    rows = fx(spark, sf_dir, "fx_fn").select("sym", text(F.col("sym"), F.when(F.col("sym") % 3 == 0, F.col("sym") % 100)).alias("node"))
    return facts.typed(rows, "node").select("sym", "node.symbol", "node.local")


@query("SELECT DISTINCT concat('0x', lpad(lower(to_hex(l_suppkey)), 16, '0')) AS fn, concat('0x', lpad(lower(to_hex(l_orderkey)), 16, '0')) AS callsite, concat('0x', lpad(lower(to_hex(l_partkey)), 16, '0')) AS callee, CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS BIGINT) AS nargs FROM lineitem", "fx_seed")
def src_function_folders(spark, sf_dir):
    """Function folders 0x..., each with a Call.facts of its own; last columns may be missing. A function is a supplier."""
    path = new_path(spark, "functions")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_partkey", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("string")).alias("n")).distinct()
    rows = line.select(text(F.col("l_suppkey")).alias("fn"), F.concat_ws("\t", text(F.col("l_orderkey")), text(F.col("l_partkey")), "n").alias("value"))
    facts.write_by_function(rows, path, "Call")
    return facts.read_by_function(spark, path, "Call").select("fn", "callsite", "callee", "nargs")


FOLDER = (
    "+n AS (SELECT fn, dst AS node FROM fd_edge UNION SELECT fn, src FROM fd_edge), i AS (SELECT unnest(range(0, 4)) AS k), st AS (SELECT fn, k, node AS core, CASE k WHEN 0 THEN node WHEN 1 THEN concat('*', node) WHEN 2 THEN concat('**', node) ELSE concat('$***', node) END AS s FROM n, i) "
    "SELECT 'IsSymbol' AS relation, fn, node AS a, NULL AS b FROM n WHERE node NOT LIKE '%:%' UNION ALL SELECT 'EnclosingFunctionForLocal', fn, fn, node FROM n WHERE node LIKE '%:%' "
    "UNION ALL SELECT 'IsAlloca', n.fn, node, NULL FROM n JOIN fd_fn f ON f.fn = n.fn WHERE node LIKE '%:%' AND CAST(split_part(node, ':0x', 2) AS BIGINT) < num_allocas UNION ALL SELECT 'ValueName', fn, core, s FROM st "
    "UNION ALL SELECT 'Starred', a.fn, b.s, a.s FROM st a JOIN st b ON b.fn = a.fn AND b.core = a.core AND b.k = least(a.k + 1, 3) UNION ALL SELECT 'SbomTable', fn, component, version FROM fd_fn WHERE component IS NOT NULL "
    "UNION ALL SELECT 'InlineFunctions', concat('0x', CAST(c_custkey AS VARCHAR)), concat('0x', CAST(c_custkey AS VARCHAR)), c_name FROM customer WHERE concat('0x', CAST(c_custkey AS VARCHAR)) IN (SELECT fn FROM fd_fn)"
)


@query(FOLDER, "fd_edge", "fd_fn")
def src_side_tables(spark, sf_dir):
    """All side tables of all functions, written in one go and read back; what is inlined in unknown functions is left out."""
    path = new_path(spark, "functions")
    functions = fx(spark, sf_dir, "fd_fn")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("0x"), F.col("c_custkey").cast("string")).alias("fn"), F.col("c_name").alias("inlined_name"))
    inlined = folders.known_only(customer.withColumn("inliner", F.col("fn")), functions, "InlineFunctions")
    folders.write(folders.side_tables(fx(spark, sf_dir, "fd_edge"), functions).unionByName(inlined), path)
    shown = {"IsSymbol": ("node",), "IsAlloca": ("node",), "EnclosingFunctionForLocal": ("func", "local"), "Starred": ("starred", "node"), "ValueName": ("core", "value"), "SbomTable": ("component", "version"), "InlineFunctions": ("inliner", "inlined_name")}
    return folders.shown(folders.read_all(spark, path, *shown), shown)


@query("SELECT concat('V-', CAST(p_partkey AS VARCHAR)) AS cve_id, p_brand AS package_name, concat('<=', CAST(p_size AS VARCHAR), '.0.0') AS package_version, p_name AS affected_function, CAST(CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n_waypoints FROM part", "fx_seed")
def src_vulnerabilities(spark, sf_dir):
    """A vulnerability for each part, a file for each brand."""
    path = new_path(spark, "vulnerabilities")
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    way = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("main"), F.col("p_brand")))
    one = F.struct(F.concat(F.lit("V-"), F.col("p_partkey").cast("string")).alias("cve-id"), F.col("p_brand").alias("package-name"), F.concat(F.lit("<="), F.col("p_size").cast("string"), F.lit(".0.0")).alias("package-version"), F.col("p_name").alias("affected-function"), way.alias("waypoint-syms"))
    p.groupBy("p_brand").agg(F.collect_list(one).alias("vulnerabilities")).select(F.to_json(F.struct("vulnerabilities"))).write.option("maxRecordsPerFile", 1).text(path)
    return facts.read_vulnerabilities(spark, path).select("cve_id", "package_name", "package_version", "affected_function", F.size("waypoint_syms").alias("n_waypoints"))


@query("SELECT concat('C-', CAST(sym AS VARCHAR)) AS cve_id, 'unreachable' AS classification, fname AS justification, CAST(sym AS BIGINT) AS address, CAST(NULL AS VARCHAR) AS screach_log FROM fx_fn", "fx_fn")
def src_results(spark, sf_dir):
    path = new_path(spark, "results")
    f = fx(spark, sf_dir, "fx_fn")
    f.select(F.concat(F.lit("C-"), F.col("sym").cast("string")).alias("cve_id"), F.lit("unreachable").alias("classification"), F.col("fname").alias("justification"), F.col("sym").alias("address")).write.json(path)
    return facts.read_results(spark, path, lines=True)


@query("SELECT CAST(caller AS VARCHAR) AS func, CAST(ok * 10 + ln AS VARCHAR) AS addr, CAST(callee AS VARCHAR) AS callee FROM fx_call_direct", "fx_call_direct")
def src_call_graph(spark, sf_dir):
    path = new_path(spark, "callgraph")
    d = fx(spark, sf_dir, "fx_call_direct")
    rows = d.select(F.concat_ws("\t", F.col("caller").cast("string"), (F.col("ok") * 10 + F.col("ln")).cast("string"), F.col("callee").cast("string")).alias("value"))
    rows.unionByName(rows.limit(3).select(F.lit("a short line").alias("value"))).write.text(path)
    return facts.read_call_graph(spark, path)


@query("SELECT concat('0x', lpad(lower(to_hex(src)), 16, '0')) AS src, concat('0x', lpad(lower(to_hex(dst)), 16, '0')) AS dst FROM fx_call", "fx_call")
def src_svf_call_graph(spark, sf_dir):
    path = new_path(spark, "svf")
    fx(spark, sf_dir, "fx_call").select(F.concat(text(F.col("src")), F.lit(":0x0001"), F.lit(", "), text(F.col("dst"))).alias("value")).write.text(path)
    return facts.read_svf_call_graph(spark, path)


@query("SELECT CAST(fn AS BIGINT) AS src_symbol, CAST(CASE WHEN ln > 2 THEN ln END AS INTEGER) AS src_local, CAST(tgt AS BIGINT) AS dst_symbol FROM fx_line", "fx_line")
def src_points_to(spark, sf_dir):
    path = new_path(spark, "pts")
    number = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    fx(spark, sf_dir, "fx_line").select(F.concat_ws(",", number("fn"), F.when(F.col("ln") > 2, number("ln")).otherwise("-"), number("tgt"), F.lit("-")).alias("value")).write.text(path)
    return facts.read_points_to(spark, path).select(F.col("src.symbol").alias("src_symbol"), F.col("src.local").alias("src_local"), F.col("dst.symbol").alias("dst_symbol"))


@query("SELECT DISTINCT concat('f_', CAST(src AS VARCHAR)) AS src, concat('f_', CAST(dst AS VARCHAR)) AS dst FROM fx_call", "fx_call")
def src_dot(spark, sf_dir):
    path = new_path(spark, "dot")
    calls = fx(spark, sf_dir, "fx_call").select("src", "dst").distinct()
    number = lambda c: F.concat(F.lit("Node0x"), F.lower(F.hex(c)))
    ends = calls.select(F.col("src").alias("n")).union(calls.select("dst")).distinct()
    rows = ends.select(F.concat(number("n"), F.lit(' [shape=record,label="{f_'), F.col("n").cast("string"), F.lit('}"];')).alias("value"))
    rows.unionByName(calls.select(F.concat(number("src"), F.lit(" -> "), number("dst"), F.lit(";")).alias("value"))).write.text(path)
    return facts.read_dot(spark, path)


@query("SELECT DISTINCT concat('f', CAST(sym AS VARCHAR), '.c') AS file, component, version FROM fx_fn", "fx_fn")
def src_file_table(spark, sf_dir):
    path = new_path(spark, "files")
    f = fx(spark, sf_dir, "fx_fn")
    entry = F.map_from_arrays(F.array(F.concat(F.lit("f"), F.col("sym").cast("string"), F.lit(".c"))), F.array(F.struct("component", "version")))
    f.select(F.to_json(entry).alias("value")).write.text(path)
    return facts.read_file_table(spark, path, lines=True)


@query("SELECT concat('b', CAST(p_partkey AS VARCHAR)) AS name, CAST(p_size AS DOUBLE) AS exec_time FROM part", "fx_seed")
def src_benchmark(spark, sf_dir):
    path = new_path(spark, "benchmark")
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    one = F.struct(F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("name"), F.struct(F.col("p_size").cast("double").alias("exec_time")).alias("metrics"))
    p.groupBy((F.col("p_partkey") % 16).alias("g")).agg(F.collect_list(one).alias("tests")).select(F.to_json(F.struct("tests"))).write.option("maxRecordsPerFile", 1).text(path)
    return facts.read_benchmark(spark, path).select("name", F.col("metrics")["exec_time"].alias("exec_time"))


@query("SELECT DISTINCT component AS name, version FROM fx_fn", "fx_fn")
def src_spdx(spark, sf_dir):
    path = new_path(spark, "spdx")
    f = fx(spark, sf_dir, "fx_fn").select("component", "version").distinct()
    one = F.struct(F.col("component").alias("name"), F.col("version").alias("versionInfo"))
    f.groupBy("component").agg(F.collect_list(one).alias("packages")).select(F.to_json(F.struct("packages"))).write.option("maxRecordsPerFile", 1).text(path)
    return facts.read_spdx(spark, path)


@query("SELECT concat('inc/lib', CAST(s_suppkey % 7 AS VARCHAR), '_x/h', CAST(s_suppkey AS VARCHAR), '.h') AS file, CASE WHEN s_suppkey % 2 = 0 THEN concat('h', CAST(s_suppkey AS VARCHAR)) WHEN s_suppkey % 7 = 3 THEN 'lib3_x' END AS port FROM supplier", "fx_seed")
def src_ports(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    key = F.col("s_suppkey").cast("string")
    headers = s.select(F.concat(F.lit("inc/lib"), (F.col("s_suppkey") % 7).cast("string"), F.lit("_x/h"), key, F.lit(".h")).alias("file"))
    packages = s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("h"), key).alias("name"))
    return facts.ports(headers, packages.unionByName(s.where("s_suppkey % 7 = 3").select(F.lit("lib3_x").alias("name")).distinct()))


@query("SELECT dst AS fn, dst, src, CASE WHEN (SELECT any_value(fname) FROM fx_fn WHERE sym = dst) LIKE '%globals%' THEN 'initialiser' ELSE 'function' END AS side FROM fx_assign", "fx_assign", "fx_fn")
def src_routed(spark, sf_dir):
    edges = fx(spark, sf_dir, "fx_assign").select(F.col("dst").alias("fn"), "dst", "src")
    ordinary, initial = facts.routed(edges, fx(spark, sf_dir, "fx_fn").select(F.col("sym").alias("fn"), F.col("fname").alias("name")))
    return ordinary.withColumn("side", F.lit("function")).unionByName(initial.withColumn("side", F.lit("initialiser")))


def packed(df, columns: list[str], form: str, path: str) -> None:
    """Little-endian records of the columns in files; the last byte of a record is 0 and is the writer's separator."""

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(len(columns))), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([struct.pack(form, *r)[:-1] for r in rows], pa.binary())], names=["value"])

    value = df.select(*columns).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    value.write.option("lineSep", "\0").text(path)


@query("SELECT DISTINCT CAST(site // 2 * 2 AS BIGINT) AS site, CAST(val AS BIGINT) AS value FROM fx_trace", "fx_trace")
def src_traces(spark, sf_dir):
    path = new_path(spark, "traces")
    packed(fx(spark, sf_dir, "fx_trace").withColumn("val", F.col("val").cast("bigint")), ["site", "val"], "<QQ", path)
    return binary.read_traces(spark, path).select(F.col("site").cast("bigint").alias("site"), F.col("value").cast("bigint").alias("value")).distinct()


def framed(spark, functions, edges, locals_=None):
    """Objects with a frame for some 64 functions, written as files and read back as frames. functions: fn and what is known of it; edges, locals_: fn and theirs."""
    ends = {"to_local": "bigint", "from_local": "bigint", "idx": "bigint"}
    edges = edges.withColumns({c: F.lit(None).cast(t) for c, t in ends.items() if c not in edges.columns})
    by = edges.groupBy("fn").agg(F.collect_list(F.struct("rel", "to_symbol", "to_local", "from_symbol", "from_local", "idx")).alias("edges"))
    known = functions.join(by, "fn", "left").withColumn("edges", F.coalesce("edges", F.array().cast(by.schema["edges"].dataType)))
    if locals_ is None:
        known = known.withColumn("names", F.array().cast("array<string>"))
    else:
        names = locals_.groupBy("fn").agg(F.transform(F.array_sort(F.collect_list(F.struct("local", "name"))), lambda x: x["name"]).alias("names"))
        known = known.join(names, "fn", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    one = F.struct("fn", "component", "version", "num_allocas", "names", "edges")
    units = known.groupBy(F.expr("fn div 64").alias("unit")).agg(F.collect_list(one).alias("functions"))
    path = new_path(spark, "objects")
    frames.images(units).select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    return frames.read_frames(spark, path)


@query("SELECT dst AS fn, 'Assign' AS rel, dst AS to_symbol, src AS from_symbol FROM fx_assign UNION ALL SELECT dst, 'Store', dst, src FROM fx_store", "fx_assign", "fx_store")
def src_graph_frames(spark, sf_dir):
    of = lambda n, rel: fx(spark, sf_dir, n).select(F.col("dst").alias("fn"), F.lit(rel).alias("rel"), F.col("dst").alias("to_symbol"), F.col("src").alias("from_symbol"))
    edges = of("fx_assign", "Assign").unionByName(of("fx_store", "Store"))
    return frames.edges(framed(spark, fx(spark, sf_dir, "gf_fn").withColumn("num_allocas", F.lit(0)), edges)).select("fn", "rel", "to_symbol", "from_symbol")


@query("SELECT * FROM gf_edge", "gf_edge")
def src_frame_edges(spark, sf_dir):
    """Every line an edge of its function's frame, between symbols and locals, some with an index."""
    return frames.edges(_frames_of(spark, sf_dir)).drop("path")


@query("SELECT f.fn, count(local) AS num_locals, least(count(local), min(num_allocas)) AS num_allocas, component, version FROM gf_fn f LEFT JOIN gf_local l ON l.fn = f.fn GROUP BY f.fn, component, version", "gf_fn", "gf_local")
def src_frame_functions(spark, sf_dir):
    """Functions with their counts and the component of their software, from the streams and the debug strings."""
    return frames.functions(_frames_of(spark, sf_dir)).drop("path")


@query("SELECT fn, local, name FROM gf_local", "gf_local")
def src_frame_locals(spark, sf_dir):
    """Names of locals, from the delta-coded places of the debug data."""
    return frames.local_names(_frames_of(spark, sf_dir)).drop("path")


def _frames_of(spark, sf_dir):
    local = fx(spark, sf_dir, "gf_local")
    count = local.groupBy("fn").agg(F.count("*").alias("n"))
    functions = fx(spark, sf_dir, "gf_fn").join(count, "fn", "left").withColumn("num_allocas", F.least(F.coalesce("n", F.lit(0)), "num_allocas")).drop("n")
    return framed(spark, functions, fx(spark, sf_dir, "gf_edge"), local)


@query("SELECT site, val, CAST(min(event_id) AS BIGINT) AS n FROM (SELECT site, val * 2 AS val, event_id FROM fx_trace) GROUP BY 1, 2", "fx_trace")
def src_trace_words(spark, sf_dir):
    """Words of buffers: each event's buffer has its value twice over and its number, eight bytes each."""
    t = fx(spark, sf_dir, "fx_trace")

    def run(batches):
        for b in batches:
            data = [struct.pack("<2Q", v * 2, e) for v, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(data, pa.binary())], names=["site", "event_id", "data"])

    buffers = t.select(F.col("site").cast("bigint").alias("site"), F.col("val").cast("bigint").alias("val"), F.col("event_id").cast("bigint").alias("event_id")).mapInArrow(run, "site bigint, event_id bigint, data binary")
    words = traces.words(buffers.select(F.struct("site", "event_id").alias("site"), "data"))
    small = t.select(F.struct(F.col("site").cast("bigint").alias("site"), F.col("event_id").cast("bigint").alias("event_id")).alias("site"), (F.col("val") * 2).cast("bigint").alias("word"))
    both = words.join(small, "site").where("CAST(val AS BIGINT) = word")
    return both.groupBy(F.col("site.site").alias("site"), F.col("word").alias("val")).agg(F.min("site.event_id").alias("n"))


@query("SELECT s_suppkey AS line, list_transform(list_sort(list(o_orderkey)), lambda x: concat(CAST(x AS VARCHAR), '-', CAST(x + 3 AS VARCHAR))) AS ranges FROM (SELECT o_orderkey, o_custkey % 100 AS s_suppkey FROM orders) GROUP BY 1", "fx_seed")
def src_source_lines(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit("a.c").alias("file"), (F.col("o_custkey") % 100).alias("line"), F.lit(1).alias("col"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 3).alias("end"))
    return binary.source_lines(o).select("line", F.transform("ranges", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))).alias("ranges"))


@query("SELECT concat('C-', CAST(p_partkey AS VARCHAR)) AS id, CASE WHEN p_size % 2 = 0 THEN 'unreachable' ELSE 'potentially reachable' END AS classification, p_name AS justification FROM part", "fx_seed")
def sink_results(spark, sf_dir):
    path = new_path(spark, "verdicts")
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    verdict = F.when(F.col("p_size") % 2 == 0, F.lit("unreachable")).otherwise(F.lit("potentially reachable"))
    reports.results_json(p.select(F.concat(F.lit("C-"), F.col("p_partkey").cast("string")).alias("cve_id"), verdict.alias("classification"), F.col("p_name").alias("justification"))).write.text(path)
    return spark.read.schema("`cve-id` string, classification string, justification string").json(path).select(F.col("cve-id").alias("id"), "classification", "justification")
