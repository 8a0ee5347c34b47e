"""Fact tables in text: tab-separated relations, vulnerabilities and results in JSON, call graphs, points-to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nodes import from_text

# fixed values: the relations' columns
SCHEMAS = {
    "Assign": "to string, from string",
    "Load": "to string, from string",
    "Store": "to string, from string",
    "Return": "to string, from string",
    "Dlsym": "to string, from string",
    "Call": "callsite string, callee string, nargs bigint",
    "ArgumentDefinition": "value string, func string, arg_no bigint",
    "ArgumentSupply": "callsite string, value string, arg_no bigint",
    "IsSymbol": "node string",
    "IsAlloca": "node string",
    "EnclosingFunctionForLocal": "func string, local string",
    "DebugTable": "node string, name string",
    "SbomTable": "func string, component string, version string",
    "Starred": "starred string, node string",
    "ValueName": "core string, value string",
    "NodeInstructions": "addr string, node string",
    "FastNodeInstructions": "addr string, node string",
    "InlineFunctions": "inliner string, inlined_name string",
    "FunctionName": "function string, name string",
    "reachable": "function string",
}
VULNERABILITY = "`cve-id` string, `cve-description` string, `package-name` string, `package-version` string, `cwe-id` string, `cwe-name` string, `affected-function` string, `affected-file` string, `additional-required-syms` array<string>, `waypoint-syms` array<string>"
RESULT = "cve_id string, classification string, justification string, address bigint, screach_log string"


def read_relation(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One relation from a file, folder or glob; lines are stripped, blank ones skipped, and missing last columns null."""
    rows = spark.read.option("sep", "\t").option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("quote", "").schema(SCHEMAS[name]).csv(path)
    return rows.where(" OR ".join(f"`{c}` IS NOT NULL" for c in rows.columns))


def read_gzip_sniffed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """As read_relation, where files may be gzip by their first bytes, whatever their name."""
    import gzip

    import pyarrow as pa

    fields = [f.split(" ") for f in SCHEMAS[name].split(", ")]

    def run(batches):
        for b in batches:
            for data in b.column(0):
                raw = data.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                lines = [x.strip().split("\t") for x in raw.decode().split("\n") if x.strip()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] if i < len(x) else None for x in lines], pa.string()) for i in range(len(fields))], names=[f[0] for f in fields])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"{f[0]} string" for f in fields))
    return rows.select(*(F.col(n).cast(t).alias(n) for n, t in fields))


def read_by_function(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A relation of all function folders 0x... (or as write_by_function makes them) under root, with the folder as `fn`."""
    rows = read_relation(spark, f"{root}/*0x*/*{name}.facts", name)
    return rows.withColumn("fn", F.regexp_extract(F.input_file_name(), r"/(?:fn=)?(0x[0-9a-fA-F]+)/", 1))


def function_names(spark: SparkSession, root: str) -> DataFrame:
    """name, fn of the folders' function-name.txt; empty names are skipped, the last folder of a name wins."""
    rows = spark.read.text(f"{root}/0x*/function-name.txt", wholetext=True).select(F.trim(F.regexp_replace("value", r"\s+$", "")).alias("name"), F.regexp_extract(F.input_file_name(), r"/(0x[0-9a-fA-F]+)/[^/]*$", 1).alias("fn"))
    return rows.where("name <> ''").groupBy("name").agg(F.max("fn").alias("fn"))


def typed(rows: DataFrame, *columns: str) -> DataFrame:
    """Node columns from text to struct of symbol and local."""
    return rows.withColumns({c: from_text(F.col(c)) for c in columns})


def combined(tables: list[DataFrame]) -> DataFrame:
    from ..operators.fixpoint import union

    return union(tables)


def routed(edges: DataFrame, names: DataFrame, marker: str = "globals") -> tuple[DataFrame, DataFrame]:
    """(edges of ordinary functions, edges of initialiser functions). edges: fn; names: fn, name."""
    known = edges.join(names.select("fn", "name"), "fn", "left")
    within = F.coalesce(F.col("name").contains(marker), F.lit(False))
    return known.where(~within).select(*edges.columns), known.where(within).select(*edges.columns)


def read_vulnerabilities(spark: SparkSession, path: str) -> DataFrame:
    """One row a vulnerability, names with underscores; missing lists are empty."""
    rows = spark.read.option("multiLine", True).schema(f"vulnerabilities array<struct<{VULNERABILITY.replace(' string', ':string').replace(' array', ':array')}>>").json(path).select(F.explode("vulnerabilities").alias("v")).select("v.*")
    lists = ("additional-required-syms", "waypoint-syms")
    return rows.select(*((F.coalesce(rows[f"`{c}`"], F.array().cast("array<string>")) if c in lists else rows[f"`{c}`"]).alias(c.replace("-", "_")) for c in rows.columns))


def read_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Results of files that hold one JSON value each, or (lines) one a line."""
    return spark.read.option("multiLine", not lines).schema(RESULT).json(path)


def read_call_graph(spark: SparkSession, path: str) -> DataFrame:
    """func, addr, callee of tab-separated lines; shorter ones are dropped."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where(F.size(parts) >= 3).select(parts[0].alias("func"), parts[1].alias("addr"), parts[2].alias("callee"))


def read_svf_call_graph(spark: SparkSession, path: str) -> DataFrame:
    """src, dst: the source cut to 0x and 16 digits."""
    return spark.read.csv(path, schema="src string, dst string").select(F.substring("src", 1, 18).alias("src"), F.trim("dst").alias("dst"))


def read_points_to(spark: SparkSession, path: str) -> DataFrame:
    """src, dst as structs of symbol and local; a line of another form is an error."""
    form = r"^(0x[0-9a-f]+),(0x[0-9a-f]+|-),(0x[0-9a-f]+),(0x[0-9a-f]+|-)$"
    rows = spark.read.text(path).where("trim(value) <> ''").withColumn("value", F.when(F.col("value").rlike(form), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a points-to row: "), "value")).cast("string")))
    number = lambda i: F.conv(F.substring(F.nullif(F.regexp_extract("value", form, i), F.lit("-")), 3, 16), 16, 10)
    node = lambda i: F.struct(number(i).cast("bigint").alias("symbol"), number(i + 1).cast("int").alias("local"))
    return rows.select(node(1).alias("src"), node(3).alias("dst"))


def read_dot(spark: SparkSession, path: str) -> DataFrame:
    """src, dst: labels of the edges of a DOT graph."""
    lines = spark.read.text(path)
    label = F.regexp_extract("value", r'(Node0x[0-9a-f]+) \[.*label="\{?([^"}|]*)', 2)
    nodes = lines.select(F.regexp_extract("value", r"(Node0x[0-9a-f]+) \[", 1).alias("id"), F.trim(label).alias("name")).where("id <> ''")
    edges = lines.select(F.regexp_extract("value", r"(Node0x[0-9a-f]+)[^-]*->\s*(Node0x[0-9a-f]+)", 1).alias("a"), F.regexp_extract("value", r"(Node0x[0-9a-f]+)[^-]*->\s*(Node0x[0-9a-f]+)", 2).alias("b")).where("a <> ''")
    return edges.join(nodes.select(F.col("id").alias("a"), F.col("name").alias("src")), "a").join(nodes.select(F.col("id").alias("b"), F.col("name").alias("dst")), "b").select("src", "dst")


def read_file_table(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """file, component, version of a JSON map from file to software component; lines: one map a line."""
    rows = spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", "map<string,struct<component:string,version:string>>")).alias("file", "c"))
    return rows.select("file", "c.component", "c.version")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """name, metrics of a benchmark run."""
    rows = spark.read.option("multiLine", True).schema("tests array<struct<name:string,metrics:map<string,double>>>").json(path)
    return rows.select(F.explode("tests").alias("t")).select("t.name", "t.metrics")


def read_spdx(spark: SparkSession, path: str) -> DataFrame:
    """name, version of the packages of an SPDX document."""
    return spark.read.option("multiLine", True).schema("packages array<struct<name:string,versionInfo:string>>").json(path).select(F.explode("packages").alias("p")).select("p.name", F.col("p.versionInfo").alias("version"))


def first_process(files: DataFrame) -> DataFrame:
    """The executable of the smallest process number among those with a graph section. files: pid, exe, has_graph."""
    return files.where("has_graph").groupBy().agg(F.min_by(F.struct("pid", "exe"), "pid").alias("f")).select("f.*").where("pid IS NOT NULL")


def component_of(functions: DataFrame, files: DataFrame, component: str, version: str) -> DataFrame:
    """functions (fn, file) with component and version of their file, else the module's."""
    return functions.join(files, "file", "left").select("fn", F.coalesce("component", F.lit(component)).alias("component"), F.coalesce("version", F.lit(version)).alias("version"))


def ports(headers: DataFrame, packages: DataFrame) -> DataFrame:
    """file, port of headers: by stem, then the stem before an underscore, then the folder."""
    from ..functions.names import include_port

    keys = headers.select("file", F.posexplode(include_port(F.col("file"))).alias("rank", "name"))
    hit = keys.join(packages.select("name").distinct(), "name")
    best = hit.groupBy("file").agg(F.min_by("name", "rank").alias("port"))
    return headers.join(best, "file", "left").select("file", "port")


def write_by_function(rows: DataFrame, root: str, name: str) -> None:
    """rows (fn, value: a line) in a folder a function, root/fn=<fn>/relation=<name>.facts, so that read_by_function finds them. Rows of a function come together first."""
    rows.select("fn", F.lit(f"{name}.facts").alias("relation"), "value").repartition("fn").write.partitionBy("fn", "relation").mode("append").text(root)


def write_relation(rows: DataFrame, path: str) -> None:
    rows.write.option("sep", "\t").option("quote", "").csv(path)
