"""Headers' ports, files of results, names of locals and verdict texts, each over whole tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import facts, reports, triage
from ..sources import headers, sinks
from ..storage import new_path
from .fixtures import fx
from .registry import query


@query(
    "+pkg AS (SELECT root, name, arg_max(version, path) AS version FROM hp_port WHERE root <> '/r4' AND path LIKE '%/share/%' GROUP BY 1, 2), "
    "asked AS (SELECT path, root, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.(h|hpp)$', '') AS stem, split_part(regexp_extract(path, '[^/]*$'), '_', 1) AS before, regexp_extract(path, '/include/([^/]+)', 1) AS folder FROM hp_header WHERE NOT ends_with(path, '.c')) "
    "SELECT q.path AS file, coalesce(a.name, b.name, c.name) AS name, coalesce(a.version, b.version, c.version) AS version FROM asked q LEFT JOIN pkg a ON a.root = q.root AND a.name = stem LEFT JOIN pkg b ON b.root = q.root AND b.name = before LEFT JOIN pkg c ON c.root = q.root AND c.name = folder WHERE coalesce(a.name, b.name, c.name) IS NOT NULL",
    "hp_header",
    "hp_port",
)
def src_header_ports(spark, sf_dir):
    """Folders from compiler calls, ports from documents, headers by name or folder, published under a name by content and read back."""
    args = [["cc", "-I", "/r0/include", "-c"], ["-I/r1"], ["-isystem", "/r2/"], ["--include-directory", "/r3/include/"], ["cc", "-I"]]
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    every = F.array(*(F.array(*map(F.lit, a)) for a in args))
    roots = headers.include_roots(nation.select(F.get(every, (F.col("n_nationkey") % 5).cast("int")).alias("args")))
    port = lambda kind, name: F.struct(F.lit(kind).alias("SPDXID"), name.alias("name"), F.col("version").alias("versionInfo"))
    content = F.to_json(F.struct(F.array(port("SPDXRef-resource-1", F.lit("h1")), port(headers.PORT, F.col("name"))).alias("packages")))
    packages = headers.port_packages(fx(spark, sf_dir, "hp_port").select("path", content.alias("content")), roots)
    found = headers.header_ports(fx(spark, sf_dir, "hp_header").select("path"), packages, roots)
    return headers.read_sbom(spark, headers.publish(headers.sbom_lines(found), new_path(spark, "sbom"), "sbom"))


@query("SELECT a.addr, coalesce(s.name, '<unknown>') AS name, CASE WHEN s.name IS NULL THEN '<unknown>' WHEN starts_with(s.name, '_ZN') THEN substr(s.name, 9, 8) WHEN starts_with(s.name, '_Z') THEN '<invalid>' ELSE s.name END AS function FROM (SELECT DISTINCT addr FROM fx_addr) a LEFT JOIN sk_symbol s ON a.addr >= s.addr AND a.addr < s.addr + s.size", "fx_addr", "sk_symbol")
def sink_missing(spark, sf_dir):
    """Addresses of functions without a body, named by the symbols that hold them, written, and read for the report of short names."""
    path = new_path(spark, "missing")
    sinks.write_missing(sinks.named(fx(spark, sf_dir, "fx_addr").select("addr").distinct(), fx(spark, sf_dir, "sk_symbol")), path)
    return sinks.missing_report(sinks.read_missing(spark, path))


@query("SELECT CASE WHEN sym % 4 < 2 THEN sym END AS addr, CASE WHEN sym % 4 = 2 THEN concat('sig.', CAST(sym AS VARCHAR)) END AS value FROM fx_fn WHERE sym % 4 < 3", "fx_fn")
def sink_reachable(spark, sf_dir):
    """Reachable functions as numbers and as texts of addresses; locals are left out, other texts come back apart."""
    path = new_path(spark, "reachable")
    sym = F.col("sym").cast("string")
    node = F.when(F.col("sym") % 4 == 0, sym).when(F.col("sym") % 4 == 1, F.concat(F.lit("0x"), F.hex("sym"))).when(F.col("sym") % 4 == 2, F.concat(F.lit("sig."), sym)).otherwise(F.concat(F.lit("0x"), F.hex("sym"), F.lit(":0x1")))
    sinks.write_reachable(fx(spark, sf_dir, "fx_fn").select(node.alias("node")), path)
    found, other = sinks.read_reachable(spark, path)
    return found.select("addr", F.lit(None).cast("string").alias("value")).unionByName(other.select(F.lit(None).cast("bigint").alias("addr"), "value"))


SLICE = (
    "+near AS (SELECT DISTINCT src, dst FROM fx_call), f AS (SELECT 97::BIGINT AS n UNION SELECT dst FROM f JOIN near ON src = n), b AS (SELECT 12::BIGINT AS n UNION SELECT src FROM b JOIN near ON dst = n), "
    "inside AS (SELECT n FROM f WHERE n IN (SELECT n FROM b) UNION SELECT 97 UNION SELECT 12), nm AS (SELECT sym, CASE WHEN sym % 10 <> 3 THEN fname ELSE CAST(sym AS VARCHAR) END AS name FROM fx_fn) "
    "SELECT concat('  \"', a.name, '\" -> \"', c.name, '\";') AS line FROM near JOIN nm a ON a.sym = src JOIN nm c ON c.sym = dst WHERE src IN (SELECT n FROM inside) AND dst IN (SELECT n FROM inside) UNION ALL SELECT 'digraph {' UNION ALL SELECT '}'"
)


@query(SLICE, "fx_call", "fx_fn", recursive=True)
def sink_slice_dot(spark, sf_dir):
    """The calls on paths between two functions, by name, as a DOT file."""
    path = new_path(spark, "dot")
    calls = fx(spark, sf_dir, "fx_call").select(F.concat(F.col("src").cast("string"), F.lit(":0x0001")).alias("src"), F.col("dst").cast("string").alias("dst"), "kind")
    known = fx(spark, sf_dir, "fx_fn").where("sym % 10 <> 3").select(F.col("sym").cast("string").alias("node"), F.col("fname").alias("name"))
    sinks.write_lines(sinks.slice_lines(calls, known, "globals_97", "f_12"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("+t AS (SELECT concat('t', CAST(l_partkey AS VARCHAR)) AS name, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS first, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS second FROM lineitem GROUP BY 1) SELECT name, CAST(first AS DOUBLE) AS first, CAST(second AS DOUBLE) AS second, round((first - second) / second * 100, 6) AS change FROM t WHERE first IS NOT NULL", "fx_seed")
def sink_comparison(spark, sf_dir):
    """Two runs of tests compared, as CSV."""
    path = new_path(spark, "comparison")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("name"), F.col("l_quantity").cast("double").alias("q"), "l_returnflag")
    run = lambda flag: line.where(F.col("l_returnflag") == flag).groupBy("name").agg(F.create_map(F.lit("compile_time"), F.sum("q")).alias("metrics"))
    sinks.write_comparison(sinks.comparison(run("A"), run("N"), "compile_time"), path, "first", "second")
    read = spark.read.option("header", True).schema("name string, first double, second double, change double").csv(path)
    return read.withColumn("change", F.round("change", 6))


@query("SELECT fn, local, concat('LOCAL', CASE WHEN contains(debug, 'i.') THEN 'i_' ELSE 'p_' END, right(debug, 1), repeat('_1', CAST(row_number() OVER (PARTITION BY fn, debug ORDER BY local) - 1 AS BIGINT))) AS name FROM sk_local", "sk_local")
def fx_local_names(spark, sf_dir):
    """Identifiers of all locals of each function, no two alike."""
    return names.local_names(fx(spark, sf_dir, "sk_local"))


@query(
    "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_name ELSE 'Unknown Target' END AS target, concat('Vulnerable function ', p_name, CASE WHEN p_size % 3 > 0 THEN ' is present.' ELSE ' is absent.' END) AS report, concat('node_', lower(to_hex(p_partkey)), 'x') AS ident, p_partkey AS back, "
    "CASE p_size % 4 WHEN 0 THEN 'NULL' WHEN 1 THEN 'v0' WHEN 2 THEN 'NONDET_SELECT(v0, v1)' ELSE 'NONDET_SELECT(NONDET_SELECT(v0, v1), v2)' END AS choice FROM part",
    "fx_seed",
)
def fx_report_texts(spark, sf_dir):
    """What reports make of verdict texts; identifiers of addresses and back; one of several values as an expression."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    present = F.when(F.col("p_size") % 3 > 0, F.lit(" is present. ")).otherwise(F.lit(" is absent. "))
    p = p.withColumn("text", F.concat(F.lit("Target function "), "p_name", present, F.lit(names.NO_SYMBOLS))).withColumn("ident", names.address_name(F.col("p_partkey")))
    values = F.slice(F.array(*map(F.lit, ("v0", "v1", "v2"))), F.lit(1), (F.col("p_size") % 4).cast("int"))
    return p.select("p_partkey", names.target_function(F.col("text")).alias("target"), names.report_text(F.col("text")).alias("report"), "ident", names.name_address(F.col("ident")).alias("back"), names.chosen(values).alias("choice"))


HEAD = '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"sparkreach"}},"results":['


@query(f"+o AS (SELECT fn, tgt, ROW_NUMBER() OVER (ORDER BY CAST(fn AS VARCHAR), concat(CAST(tgt AS VARCHAR), '}}')) AS n FROM fx_line) SELECT concat(CASE WHEN n > 1 THEN ',' ELSE '' END, '{{\"ruleId\":\"', CAST(fn AS VARCHAR), '\",\"n\":', CAST(tgt AS VARCHAR), '}}') AS line FROM o UNION ALL SELECT '{HEAD}' UNION ALL SELECT ']}}]}}'", "fx_line")
def sink_sarif(spark, sf_dir):
    """A whole log, with a result for each line, written in order and read back."""
    path = new_path(spark, "sarif")
    rule = F.col("fn").cast("string")
    results = fx(spark, sf_dir, "fx_line").select(rule.alias("cve_id"), F.to_json(F.struct(rule.alias("ruleId"), F.col("tgt").alias("n"))).alias("result"))
    sinks.write_lines(reports.sarif_log(results), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(
    "+c AS (SELECT DISTINCT dst, src FROM fx_store), cl AS (SELECT dst AS node, concat('PARENTclass-', CAST(src AS VARCHAR)) AS c FROM c UNION SELECT src, concat('CHILDclass-', CAST(dst AS VARCHAR)) FROM c), k AS (SELECT node, string_agg(c, ' ' ORDER BY c) AS classes FROM cl GROUP BY node) "
    "SELECT concat('\"', CAST(sym AS VARCHAR), '\" [label=\"', fname, '\" class=\"', coalesce(classes, ''), '\" id=\"class-', CAST(sym AS VARCHAR), '\"];') AS line FROM fx_fn LEFT JOIN k ON node = sym UNION ALL "
    "SELECT concat('\"', CAST(src AS VARCHAR), '\" -> \"', CAST(dst AS VARCHAR), '\" [label=\"Assign\"];') FROM fx_assign UNION ALL "
    "SELECT concat('\"', CAST(value AS VARCHAR), '\" -> \"', CAST(fn AS VARCHAR), '\" [label=\"ArgumentSupply (', CAST(arg_no AS VARCHAR), ')\"];') FROM fx_arg UNION ALL SELECT 'digraph {' UNION ALL SELECT '}'",
    "fx_fn",
    "fx_assign",
    "fx_store",
    "fx_arg",
)
def sink_fact_graph(spark, sf_dir):
    """Facts as DOT, functions with the classes of what is above and below them."""
    path = new_path(spark, "facts")
    of = lambda n: fx(spark, sf_dir, n)
    ends = lambda d: [F.col(a).cast("string").alias(b) for a, b in d.items()]
    assign = of("fx_assign").select(F.lit("Assign").alias("rel"), *ends({"dst": "dst", "src": "src"}), F.lit(None).cast("bigint").alias("idx"))
    supply = of("fx_arg").select(F.lit("ArgumentSupply").alias("rel"), *ends({"fn": "dst", "value": "src"}), F.col("arg_no").cast("bigint").alias("idx"))
    known = of("fx_fn").select(*ends({"sym": "node"}), F.concat("fname", F.lit(" (rnd=7)")).alias("name"))
    sinks.write_lines(reports.fact_graph(assign.unionByName(supply), known, of("fx_store").select(*ends({"dst": "dst", "src": "src"}))), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT p_partkey, p_size % 4 IN (1, 2) AND p_partkey % 3 > 0 AS analyse FROM part", "fx_seed")
def triage_to_analyse(spark, sf_dir):
    """Which verdicts a closer analysis takes up; all results come back."""
    verdict = F.get(F.array(F.lit(triage.UNREACHABLE), F.lit(triage.POSSIBLE), F.lit(triage.REACHABLE), F.lit(triage.UNKNOWN)), (F.col("p_size") % 4).cast("int"))
    results = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", verdict.alias("classification"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey")).alias("address"))
    taken, rest = triage.to_analyse(results)
    return taken.select("p_partkey", F.lit(True).alias("analyse")).unionByName(rest.select("p_partkey", F.lit(False).alias("analyse")))


@query("SELECT dst, src, CASE WHEN min(s) = 1 THEN 'first' ELSE 'second' END AS side FROM (SELECT dst, src, 1 AS s FROM fx_assign UNION SELECT dst, src, 2 FROM fx_store) GROUP BY 1, 2 HAVING count(*) = 1", "fx_assign", "fx_store")
def fact_differences(spark, sf_dir):
    """Rows that one of two relations has alone."""
    return facts.differences(fx(spark, sf_dir, "fx_assign"), fx(spark, sf_dir, "fx_store"))
