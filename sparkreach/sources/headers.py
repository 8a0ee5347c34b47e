"""Headers and the ports they come from: include flags of compiler calls, trees of headers, packages of their folders.

Everything is DataFrame functions; a tree is listed without reading its headers. A header belongs to every root above
it and is looked up among that root's packages alone; where several roots know it, the deepest counts.

Cases: a flag at the end of a call, or with nothing behind it, names no folder; documents that are not JSON, or packages
without a name, are passed over; of several versions of a port under a root, the document with the largest path counts; empty headers are not listed, as Spark's
file sources pass over empty files, but `header_ports` takes their paths.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import content_name

# fixed values: flags that name a folder of headers, suffixes of headers, a port's document and identifier
FLAGS = ("-I", "--include-directory", "-isystem", "--isystem", "--cxx-isystem", "-cxx-isystem")
SUFFIX = r"\.(h|hpp)$"
DOCUMENT = "vcpkg.spdx.json"
PORT = "SPDXRef-port"


def include_roots(calls: DataFrame, folder: str = "/") -> DataFrame:
    """root: the folders that compiler calls (args: array of strings) name for headers, an `include` at the end cut off; relative ones are in `folder`."""

    def named(arg, i):
        following = F.get("args", i + 1)
        return F.array(*(F.when(arg == flag, following).when(arg.startswith(flag), F.substring(arg, len(flag) + 1, 1 << 20)) for flag in FLAGS))

    found = calls.select(F.explode(F.array_compact(F.flatten(F.transform("args", named)))).alias("root")).where("root <> ''")
    whole = F.when(F.col("root").startswith("/"), F.col("root")).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), "root"))
    plain = F.regexp_replace(F.regexp_replace(whole, "/(\\./|/)*", "/"), "(?<=.)/\\.?$", "")
    return found.select(F.regexp_replace(plain, "/include$", "").alias("root")).where("root <> ''").distinct()


def under(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files (path, ...) with each root above them."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    deep = files.where(F.size(parts) > 2).withColumn("root", F.explode(above))
    return deep.join(roots.select("root"), "root")


def read_trees(spark: SparkSession, folders: list[str]) -> tuple[DataFrame, DataFrame]:
    """(path of every header, path and content of every port's document) below the folders."""
    local = F.regexp_replace("path", "^file:/+", "/")
    tree = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    headers = tree.option("pathGlobFilter", "*.{h,hpp}").load(folders).select(local.alias("path"))
    documents = tree.option("pathGlobFilter", DOCUMENT).load(folders).select(local.alias("path"), F.col("content").cast("string").alias("content"))
    return headers, documents


def port_packages(documents: DataFrame, roots: DataFrame) -> DataFrame:
    """root, name, version of the ports whose documents (path, content) are in a `share` folder below a root."""
    kept = documents.where(F.concat(F.lit("/"), "path").rlike("/share/") & (F.substring_index("path", "/", -1) == DOCUMENT))
    parsed = F.from_json("content", "packages array<struct<SPDXID:string,name:string,versionInfo:string>>")["packages"]
    each = under(kept, roots).select("root", "path", F.posexplode(parsed).alias("pos", "p")).where((F.col("p.SPDXID") == PORT) & F.col("p.name").isNotNull())
    return each.groupBy("root", F.col("p.name").alias("name")).agg(F.max_by("p.versionInfo", F.struct("path", "pos")).alias("version"))


def header_ports(headers: DataFrame, packages: DataFrame, roots: DataFrame) -> DataFrame:
    """file, name, version of headers (path) that a port is known for: by the name without its suffix, by the name up to an underscore, by the folder below the first `include`."""
    name = F.substring_index("path", "/", -1)
    keys = F.array(F.regexp_replace(name, SUFFIX, ""), F.substring_index(name, "_", 1), F.nullif(F.regexp_extract("path", "(?:^|/)include/([^/]+)", 1), F.lit("")))
    asked = under(headers.where(name.rlike(SUFFIX)), roots).select("root", F.col("path").alias("file"), F.posexplode(keys).alias("rank", "name"))
    hit = asked.join(packages, ["root", "name"])
    best = F.struct(-F.length("root"), F.col("rank"))
    return hit.groupBy("file").agg(F.min_by(F.struct("name", "version"), best).alias("p")).select("file", "p.name", "p.version")


def sbom_lines(ports: DataFrame) -> DataFrame:
    """value: a JSON object a header, its path to the port's name and version."""
    port = F.struct(F.col("name").alias("port-name"), F.col("version").alias("port-version"))
    return ports.select(F.to_json(F.map_from_arrays(F.array("file"), F.array(port))).alias("value"))


def read_sbom(spark: SparkSession, path: str) -> DataFrame:
    """file, name, version of what `publish` wrote of `sbom_lines`."""
    rows = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,struct<`port-name`:string,`port-version`:string>>")).alias("file", "p"))
    return rows.select("file", F.col("p.port-name").alias("name"), F.col("p.port-version").alias("version"))


def publish(lines: DataFrame, folder: str, stem: str) -> str:
    """Writes lines (value) as folder/stem-<name by content>, where they appear whole or not at all; the path. Equal lines in any order have one name."""
    spark = lines.sparkSession
    part = f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex}.partial"
    lines.select("value").write.text(part)
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), "value").cast("decimal(38,0)"))
    digest = spark.read.text(part).groupBy().agg(F.concat_ws(":", F.count("*").cast("string"), *(wide(s).cast("string") for s in range(4))).alias("d"))
    target = f"{folder.rstrip('/')}/{stem}-{digest.select(content_name(F.col('d'))).first()[0]}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(part).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(target)) or not fs.rename(path(part), path(target)):
        fs.delete(path(part), True)
        if not fs.exists(path(target)):
            raise OSError(f"cannot write {target}")
    return target
