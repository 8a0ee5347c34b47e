"""Queries of the default analysis, reports, points-to and node functions, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, nodes
from ..operators import andersen, facts, fixpoint, graph, reachability, reports
from ..sources import facts as facts_in
from .fixtures import fx
from .registry import query

# ---- the default analysis

AN = ("an_site", "an_name", "an_call", "an_edge", "an_gassign", "an_gstore", "fx_seed")
ATOMS = (
    "+gs(dst, src) AS (SELECT dst, src FROM an_gstore UNION SELECT gs.dst, a.src FROM gs JOIN an_gassign a ON gs.src = a.dst), "
    "refs AS (SELECT DISTINCT e.src AS v, s.fn AS f FROM an_edge e JOIN an_site s ON e.dst = s.site), "
    "calls AS (SELECT DISTINCT s.fn AS caller, c.callee FROM an_call c JOIN an_site s USING (site) WHERE c.callee IN (SELECT node FROM an_name)), "
    "wide AS (SELECT DISTINCT site FROM an_call WHERE callee NOT IN (SELECT node FROM an_name) OR callee IN (SELECT node FROM an_name WHERE name = 'pthread_create')), "
    "step AS (SELECT 'R' AS a, caller AS x, 'R' AS b, callee AS y FROM calls UNION SELECT 'R', f, 'Q', v FROM refs UNION SELECT 'Q', dst, 'Q', src FROM an_edge WHERE rel = 'Store' UNION SELECT 'Q', dst, 'Q', src FROM gs), "
    "r1(k, n) AS (SELECT 'R', CAST(sym AS VARCHAR) FROM fx_seed UNION SELECT b, y FROM r1 JOIN step ON k = a AND n = x), "
    "flag AS (SELECT count(*) > 0 AS yes FROM r1 JOIN an_site s ON k = 'R' AND n = s.fn WHERE s.site IN (SELECT site FROM wide)), "
    "more AS (SELECT * FROM step UNION SELECT 'Q', y, 'R', y FROM step WHERE b = 'Q' AND (SELECT yes FROM flag)), "
    "r2(k, n) AS (SELECT k, n FROM r1 UNION SELECT b, y FROM r2 JOIN more ON k = a AND n = x) "
)


def analysis_facts(spark, sf_dir):
    of = lambda n: fx(spark, sf_dir, n)
    name = of("an_name")
    tables = {"edges": of("an_edge"), "calls": of("an_call"), "enclosing": of("an_site").select("fn", F.col("site").alias("local")), "symbols": name.select("node"), "names": name}
    return tables | {"global_assign": of("an_gassign"), "global_store": of("an_gstore"), "seeds": of("fx_seed").select(F.col("sym").cast("string").alias("node"))}


def analysed(spark, sf_dir):
    return reachability.analysis(analysis_facts(spark, sf_dir))


@query(ATOMS + "SELECT CASE k WHEN 'R' THEN 'reachable' ELSE 'referenced' END AS what, n AS node FROM r2", *AN, recursive=True)
def reach_facts(spark, sf_dir):
    found = analysed(spark, sf_dir)
    return found["reachable"].select(F.lit("reachable").alias("what"), "node").unionByName(found["referenced"].select(F.lit("referenced").alias("what"), "node"))


@query(ATOMS + "SELECT DISTINCT n AS node, name FROM r2 JOIN an_name ON n = node WHERE k = 'R'", *AN, recursive=True)
def reachable_names(spark, sf_dir):
    return analysed(spark, sf_dir)["names"]


@query(
    ATOMS + ", g AS (SELECT caller, callee, 'Direct' AS kind FROM calls UNION SELECT s.fn, n, 'Conservative' FROM wide JOIN an_site s USING (site), r2 WHERE k = 'Q') SELECT caller, a.name AS caller_name, callee, b.name AS callee_name, kind FROM g JOIN an_name a ON a.node = caller JOIN an_name b ON b.node = callee",
    *AN,
    recursive=True,
)
def call_graph_named(spark, sf_dir):
    return analysed(spark, sf_dir)["named"]


@query("SELECT DISTINCT e.src AS v, s.fn AS f FROM an_edge e JOIN an_site s ON e.dst = s.site", "an_edge", "an_site", "an_name")
def referenced_from(spark, sf_dir):
    of = lambda n: fx(spark, sf_dir, n)
    return reachability.referenced_from(of("an_edge"), of("an_site").select("fn", F.col("site").alias("local")), of("an_name").select("node"))


@query("+q(n) AS (SELECT src FROM an_edge WHERE rel = 'Assign' UNION SELECT e.src FROM an_edge e JOIN q ON e.dst = n WHERE rel = 'Store') SELECT n AS node FROM q", "an_edge", recursive=True)
def stored_references(spark, sf_dir):
    e = fx(spark, sf_dir, "an_edge")
    return reachability.stored_references(e.where("rel = 'Store'"), e.where("rel = 'Assign'").select(F.col("src").alias("node")))


# ---- points-to, as closures over pairs

PTS = (
    "+own AS (SELECT src AS n FROM fx_assign UNION SELECT src FROM fx_store UNION SELECT src FROM fx_load), "
    "p(x, o) USING KEY (x, o) AS (SELECT n, n FROM own UNION SELECT DISTINCT c.x, c.o FROM (SELECT a.dst AS x, p.o AS o FROM fx_assign a JOIN p ON a.src = p.x "
    "UNION ALL SELECT l.dst, w.o FROM fx_load l JOIN p ON l.src = p.x JOIN recurring.p AS w ON w.x = p.o UNION ALL SELECT l.dst, p.o FROM fx_load l JOIN recurring.p AS w ON l.src = w.x JOIN p ON p.x = w.o "
    "UNION ALL SELECT w.o, p.o FROM fx_store s JOIN p ON s.src = p.x JOIN recurring.p AS w ON w.x = s.dst UNION ALL SELECT p.o, w.o FROM fx_store s JOIN p ON s.dst = p.x JOIN recurring.p AS w ON w.x = s.src) c "
    "LEFT JOIN recurring.p AS r ON r.x = c.x AND r.o = c.o WHERE r.x IS NULL) "
)


@query(PTS + "SELECT x AS node, o AS obj FROM p", "fx_assign", "fx_store", "fx_load", recursive=True)
def pts_andersen(spark, sf_dir):
    of = lambda n: fx(spark, sf_dir, n)
    a, s, x = of("fx_assign"), of("fx_store"), of("fx_load")
    own = fixpoint.union([t.select(F.col("src").alias("node")) for t in (a, s, x)]).distinct()
    return andersen.points_to(spark, own.select("node", F.col("node").alias("obj")), a, x, s)


# ---- reports


@query(
    "+t AS (SELECT *, pos = max(pos) OVER (PARTITION BY target) AS is_last FROM fx_step) SELECT target, pos, addr, is_last, CAST(row_number() OVER (PARTITION BY target ORDER BY pos) AS INTEGER) AS nesting, name, file, line, col, end_line, end_col FROM t JOIN fx_place USING (addr) WHERE pos % 2 = 1 OR is_last",
    "fx_step",
    "fx_place",
)
def trace_steps(spark, sf_dir):
    return reports.steps(fx(spark, sf_dir, "fx_step"), fx(spark, sf_dir, "fx_place"))


NEAR = "+t AS (SELECT *, max(pos) OVER (PARTITION BY target) AS last FROM fx_step), c AS (SELECT t.*, p.*, row_number() OVER (PARTITION BY target ORDER BY pos DESC) AS k FROM t JOIN fx_place p USING (addr) WHERE p.file NOT LIKE '/%') "


@query(NEAR + "SELECT target, pos, addr, pos = last AS is_last, name, file, line, end_line FROM c WHERE k = 1", "fx_step", "fx_place")
def trace_closest(spark, sf_dir):
    return reports.closest(fx(spark, sf_dir, "fx_step"), fx(spark, sf_dir, "fx_place"), True)


@query(
    NEAR
    + "SELECT target AS cve_id, md5(concat_ws('-', 'trace-step', target, CAST(addr AS VARCHAR), CAST(pos AS VARCHAR))) AS fingerprint, concat('[', target, '] POTENTIALLY REACHABLE - Vulnerable function f_', target, CASE WHEN pos = last THEN ' reachable ' ELSE concat(' reachable from call site in ', name, ' ') END, 'at address 0x', lower(to_hex(addr)), '. seen.') AS description, file, line, end_line FROM c WHERE k = 1",
    "fx_step",
    "fx_place",
)
def code_quality(spark, sf_dir):
    t = fx(spark, sf_dir, "fx_step")
    results = t.select(F.col("target").alias("cve_id")).distinct().select("cve_id", F.lit("potentially reachable").alias("classification"), F.lit("seen").alias("justification"), F.concat(F.lit("f_"), "cve_id").alias("function"))
    rows = reports.code_quality(results, t, fx(spark, sf_dir, "fx_place"), True)
    body = F.from_json("row", "description string, location struct<path:string,lines:struct<begin:bigint,end:bigint>>")
    return rows.select("cve_id", "fingerprint", body.alias("b")).select("cve_id", "fingerprint", "b.description", F.col("b.location.path").alias("file"), F.col("b.location.lines.begin").alias("line"), F.col("b.location.lines.end").alias("end_line"))


@query(
    "+t AS (SELECT *, max(pos) OVER (PARTITION BY target) AS last FROM fx_step), c AS (SELECT t.*, p.*, row_number() OVER (PARTITION BY target ORDER BY p.file LIKE '/%', pos DESC) AS k FROM t JOIN fx_place p USING (addr)), f AS (SELECT target, count(*) AS n FROM c WHERE pos % 2 = 1 OR pos = last GROUP BY 1) "
    "SELECT f.target AS cve_id, concat('[', f.target, '] REACHABLE', chr(10), 'seen.') AS text, CASE WHEN c.pos % 2 = 1 OR c.pos = c.last THEN concat(CASE WHEN c.file LIKE '/%' THEN 'file://' ELSE '' END, c.file) END AS uri, CASE WHEN c.pos % 2 = 1 OR c.pos = c.last THEN c.end_col END AS end_col, CAST(f.n AS INTEGER) AS steps FROM f JOIN c ON c.target = f.target AND k = 1",
    "fx_step",
    "fx_place",
)
def sarif_results(spark, sf_dir):
    t, p = fx(spark, sf_dir, "fx_step"), fx(spark, sf_dir, "fx_place")
    results = t.select(F.col("target").alias("cve_id")).distinct().select("cve_id", F.lit("reachable").alias("classification"), F.lit("seen").alias("justification"))
    rows = reports.sarif(results, reports.steps(t, p), t, p)
    place = "struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<endColumn:bigint>>>"
    body = F.from_json("result", f"message struct<text:string>, locations array<{place}>, codeFlows array<struct<threadFlows:array<struct<locations:array<struct<nestingLevel:int>>>>>>")
    at = F.get("b.locations", F.lit(0))["physicalLocation"]
    return rows.select("cve_id", body.alias("b")).select("cve_id", F.col("b.message.text").alias("text"), at["artifactLocation"]["uri"].alias("uri"), at["region"]["endColumn"].alias("end_col"), F.size(F.expr("b.codeFlows[0].threadFlows[0].locations")).alias("steps"))


@query("SELECT DISTINCT site FROM an_call WHERE site NOT IN (SELECT site FROM an_site WHERE q = 1)", "an_call", "an_site")
def callsites_unplaced(spark, sf_dir):
    return reports.unplaced(fx(spark, sf_dir, "an_call"), fx(spark, sf_dir, "an_site").where("q = 1").select("site"))


@query("SELECT DISTINCT CAST(src AS VARCHAR) AS src, concat('**', coalesce(CASE WHEN dst % 2 = 0 THEN f.fname END, CAST(dst AS VARCHAR))) AS dst_name FROM fx_call c LEFT JOIN fx_fn f ON f.sym = c.dst", "fx_call", "fx_fn")
def pretty_names(spark, sf_dir):
    rows = fx(spark, sf_dir, "fx_call").select(F.col("src").cast("string").alias("src"), F.concat(F.lit("**"), F.col("dst").cast("string")).alias("dst")).distinct()
    known = fx(spark, sf_dir, "fx_fn").where("sym % 2 = 0").select(F.col("sym").cast("string").alias("node"), F.col("fname").alias("name"))
    return reports.pretty(F.col("dst"), known, rows, "dst_name").select("src", "dst_name").distinct()


@query("SELECT 1 AS pos, concat('  \"', CAST(src AS VARCHAR), '\" -> \"', CAST(dst AS VARCHAR), '\";') AS line FROM (SELECT DISTINCT src, dst FROM fx_call) UNION ALL SELECT 0, 'digraph {' UNION ALL SELECT 2, '}'", "fx_call")
def dot_lines(spark, sf_dir):
    return reports.dot(fx(spark, sf_dir, "fx_call"))


# ---- graph


@query("+p AS (SELECT caller AS src, callee AS dst, min(CASE kind WHEN 'Direct' THEN 1 WHEN 'Indirect' THEN 2 ELSE 3 END) AS k FROM fx_call_direct GROUP BY ALL) SELECT concat(CAST(src AS VARCHAR), '>', CAST(dst AS VARCHAR)) AS target, concat(CAST(src AS VARCHAR), CASE k WHEN 1 THEN ' ---> ' WHEN 2 THEN ' -I-> ' ELSE ' -?-> ' END, CAST(dst AS VARCHAR)) AS text FROM p", "fx_call_direct")
def rendered_steps(spark, sf_dir):
    calls = fx(spark, sf_dir, "fx_call")
    pairs = calls.select("src", "dst").distinct().withColumn("target", F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string")))
    path = pairs.select("target", F.posexplode(F.array("src", "dst")).alias("pos", "node"))
    return graph.rendered(path, calls)


@query("+n AS (SELECT fn AS start, ok AS node FROM fx_line), s AS (SELECT sym AS start, fname AS name FROM fx_fn) SELECT CAST(start AS VARCHAR) AS src, CAST(node AS VARCHAR) AS dst FROM n UNION SELECT name, CAST(node AS VARCHAR) FROM s JOIN n USING (start) UNION SELECT name, CAST(start AS VARCHAR) FROM s", "fx_line", "fx_fn")
def graph_bridges(spark, sf_dir):
    return graph.bridges(fx(spark, sf_dir, "fx_fn").select(F.col("sym").alias("start"), F.col("fname").alias("name")), fx(spark, sf_dir, "fx_line").select(F.col("fn").alias("start"), F.col("ok").alias("node")))


# ---- nodes and names


@query("SELECT fn, ln, ln > 2 AS is_local, CASE WHEN ln > 2 THEN ln * 2 ELSE fn * 2 + 1 END AS word, concat(coalesce(CASE WHEN fn % 5 > 0 THEN concat('f_', CAST(fn AS VARCHAR)) END, '<UnknownSymbol>'), CASE WHEN ln > 2 THEN concat(' -> ', coalesce(CASE WHEN ln % 2 = 1 THEN concat('v', CAST(ln AS VARCHAR)) END, '<DebugDataMissing>')) ELSE '' END) AS name FROM fx_line", "fx_line")
def fx_debug_names(spark, sf_dir):
    rows = fx(spark, sf_dir, "fx_line")
    local = F.when(F.col("ln") > 2, F.col("ln"))
    symbol = F.when(F.col("fn") % 5 > 0, F.concat(F.lit("f_"), F.col("fn").cast("string")))
    name = F.when(F.col("ln") % 2 == 1, F.concat(F.lit("v"), F.col("ln").cast("string")))
    return rows.select("fn", "ln", nodes.is_local(nodes.pack(F.col("fn"), local)).alias("is_local"), nodes.encode_index(F.col("fn"), local).alias("word"), nodes.debug_name(symbol, local, name).alias("name"))


@query("SELECT addr, CASE WHEN line > 0 THEN file END AS file, CASE WHEN line > 0 THEN line END AS line, CASE WHEN line > 0 THEN col END AS col, CASE WHEN line > 0 THEN name END AS name FROM fx_place", "fx_place")
def fx_locations(spark, sf_dir):
    p = fx(spark, sf_dir, "fx_place")
    found = p.withColumn("at", nodes.location(F.concat(F.concat_ws(":", "file", F.col("line").cast("string"), F.col("col").cast("string")), F.lit("|"), "name", F.when(F.col("addr") % 2 == 0, "@[x.c:1:2|y]").otherwise(""))))
    return found.select("addr", "at.file", "at.line", "at.col", "at.name")


@query("SELECT s_suppkey, regexp_replace(regexp_replace(concat(s_name, '::', s_suppkey), '\\W', '_', 'g'), '_+', '_', 'g') AS ident, CASE WHEN s_suppkey % 3 = 0 THEN concat('/new/', s_name) WHEN s_suppkey % 3 = 1 THEN concat('x/', s_name) ELSE concat('/other/', s_name) END AS mapped, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE concat(CASE s_suppkey % 3 WHEN 1 THEN '/src/' ELSE '/other/' END, s_name) END AS rel, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE s_name END AS num FROM supplier", "fx_seed")
def fx_paths(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    path = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "/old/").when(F.col("s_suppkey") % 3 == 1, "/src/").otherwise("/other/"), "s_name")
    mixed = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("0x"), F.hex("s_suppkey"))).otherwise(F.col("s_name"))
    ident = names.identifier(F.concat("s_name", F.lit("::"), F.col("s_suppkey").cast("string")))
    return s.select("s_suppkey", ident.alias("ident"), names.map_prefix(path, [("/old/", "/new/"), ("/src/", "x/")]).alias("mapped"), names.relative(path, "/old").alias("rel"), nodes.number_or_text(mixed).alias("num"))


@query("SELECT p_partkey, concat('f', CAST(p_partkey AS VARCHAR)) AS name, CAST(p_partkey % 4 AS INTEGER) AS nargs FROM part", "fx_seed")
def fx_signatures(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    args = F.when(F.col("p_partkey") % 4 == 0, F.when(F.col("p_partkey") % 8 == 0, "void").otherwise("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), (F.col("p_partkey") % 4).cast("int")), lambda i: F.concat(F.lit("int a"), i.cast("string"))), ", "))
    found = names.override_arity(F.concat(F.lit("int f"), F.col("p_partkey").cast("string"), F.lit(" ("), args, F.lit(") {")))
    return p.select("p_partkey", found["name"].alias("name"), found["nargs"].alias("nargs"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN concat('g', CAST(s_suppkey AS VARCHAR)) WHEN 1 THEN 'push_back' WHEN 2 THEN '~Box' ELSE concat('plain', CAST(s_suppkey AS VARCHAR)) END AS name FROM supplier", "fx_seed")
def fx_short_names(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    key = F.col("s_suppkey").cast("string")
    own = F.concat(F.lit("_ZN3lib"), (F.length(key) + 1).cast("string"), F.lit("g"), key, F.lit("Ei"))
    mangled = F.when(F.col("s_suppkey") % 4 == 0, own).when(F.col("s_suppkey") % 4 == 1, "_ZNSt6vectorIiSaIiEE9push_backERKi").when(F.col("s_suppkey") % 4 == 2, "_ZN3BoxD1Ev").otherwise(F.concat(F.lit("plain"), key))
    return s.select("s_suppkey", names.function_name(mangled).alias("name"))


# ---- checks and segments


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT lo, hi FROM fx_segment)", "fx_segment")
def segment_hash(spark, sf_dir):
    s = fx(spark, sf_dir, "fx_segment")
    twice = facts.segment_hash(s.unionByName(s.orderBy(F.desc("lo")))).select(F.col("digest").alias("again"))
    found = facts.segment_hash(s)
    return found.join(twice, F.col("digest") == F.col("again")).select("n")


@query("SELECT sym AS fn, coalesce(CASE WHEN sym % 4 = 0 THEN component END, 'module') AS component, coalesce(CASE WHEN sym % 4 = 0 THEN version END, '1.0') AS version FROM fx_fn", "fx_fn")
def component_of(spark, sf_dir):
    f = fx(spark, sf_dir, "fx_fn")
    file = F.concat(F.lit("f"), F.col("sym").cast("string"), F.lit(".c"))
    return facts_in.component_of(f.select(F.col("sym").alias("fn"), file.alias("file")), f.where("sym % 4 = 0").select(file.alias("file"), "component", "version"), "module", "1.0")
