"""Binary inputs: trace sites and traces, dlsym pages, object files' sections and symbols.

Files come whole from binaryFile, one a row; records are cut with numpy in Arrow batches. Numbers of 64 bits without
sign are decimals.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fixpoint import fixpoint
from .layouts import EDGE, PAGE, PAGE_POINTERS, SITE, records

BASE = r"(?:0x|[-/])([0-9a-fA-F]+)(?:\.[^/]*)?$"  # an address at the end of a file's name


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _mapped(df: DataFrame, rows, schema: str, names: list[str], types: list) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0), b.column(1), strict=True):
                columns = rows(path.as_py(), data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def read_trace_sites(spark: SparkSession, path: str) -> DataFrame:
    """site, function, local; a site's address is its place in the section whose base is in the file's name (0x...)."""
    base = F.conv(F.regexp_extract("path", BASE, 1), 16, 10).cast("decimal(20,0)")
    return records(files(spark, path), SITE).select((base + F.col("number") * SITE.size).cast("decimal(20,0)").alias("site"), "function", F.col("local").cast("bigint").alias("local"))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """site (its lowest bit cleared), value; empty records are skipped, a short tail is ignored."""
    site = (F.col("site") - F.col("site") % 2).cast("decimal(20,0)").alias("site")
    return records(files(spark, path), EDGE).select(site, "value").where("site <> 0")


def read_dlsym_pages(spark: SparkSession, path: str) -> DataFrame:
    """page (its address: the base in the file's name and its place), next, count, pointers."""
    base = F.conv(F.regexp_extract("path", BASE, 1), 16, 10).cast("decimal(20,0)")
    return records(files(spark, path), PAGE).select((base + F.col("number") * PAGE.size).cast("decimal(20,0)").alias("page"), "next", "count", "pointers")


def dlsym_pointers(pages: DataFrame, heads: DataFrame) -> DataFrame:
    """head, pointer: what the chains of pages record, without nulls. pages: page, next, count, pointers; heads: page."""
    chain = fixpoint(heads.select(F.col("page").alias("head"), "page"), lambda new, _: new.join(pages, "page").where("next IS NOT NULL AND next <> 0").select("head", F.col("next").alias("page")))
    held = chain.join(pages, "page").select("head", F.explode(F.slice("pointers", F.lit(1), F.least(F.col("count"), F.lit(PAGE_POINTERS)).cast("int"))).alias("pointer"))
    return held.where("pointer <> 0").distinct()


# ---- object files


def elf_sections(data: bytes) -> list[tuple[str, int, int, int, int, int, int]]:
    """name, type, address, offset, size, link, entry size of a 64-bit little-endian ELF file's sections."""
    if data[:6] != b"\x7fELF\x02\x01":
        raise ValueError("not a 64-bit little-endian ELF file")
    (table,) = struct.unpack_from("<Q", data, 40)
    entry, count, names = struct.unpack_from("<HHH", data, 58)
    heads = [struct.unpack_from("<IIQQQQIIQQ", data, table + i * entry) for i in range(count)]
    base = heads[names][4] if count else 0
    text = lambda at: data[at : data.index(b"\0", at)].decode()
    return [(text(base + h[0]), h[1], h[3], h[4], h[5], h[6], h[9]) for h in heads]


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """path, name, start, size, nobits."""

    def rows(name: str, data: bytes):
        s = elf_sections(data)
        return [[name] * len(s), [x[0] for x in s], [x[2] for x in s], [x[4] for x in s], [x[1] == 8 for x in s]]

    return _mapped(files(spark, path), rows, "path string, name string, start bigint, size bigint, nobits boolean", ["path", "name", "start", "size", "nobits"], [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()])


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """path, addr, name, size of the symbols of the symbol tables."""

    def rows(name: str, data: bytes):
        sections, out = elf_sections(data), []
        for _, kind, _, offset, size, link, entry in sections:
            if kind in (2, 11) and entry:
                strings = sections[link][3]
                for i in range(size // entry):
                    at, _, _, _, value, length = struct.unpack_from("<IBBHQQ", data, offset + i * entry)
                    text = data[strings + at : data.index(b"\0", strings + at)].decode(errors="replace")
                    if text and value:
                        out.append((name, value, text, length))
        return list(zip(*out, strict=True)) or [[], [], [], []]

    return _mapped(files(spark, path), rows, "path string, addr bigint, name string, size bigint", ["path", "addr", "name", "size"], [pa.string(), pa.int64(), pa.string(), pa.int64()])


def resolve_pointers(slots: DataFrame, relocations: DataFrame, sections: DataFrame) -> DataFrame:
    """slot, target: by relocation; a slot of a section without bytes and without relocation is 0; any other is an error."""
    from ..operators.ordered import floor_join

    known = slots.join(relocations, "slot", "left")
    placed = floor_join(known, "slot", sections.select("start", "size", "nobits"), "start", "size")
    bad = F.raise_error(F.concat(F.lit("no relocation at "), F.col("slot").cast("string"))).cast("bigint")
    return placed.select("slot", F.coalesce("target", F.when(F.col("nobits"), F.lit(0).cast("bigint")), bad).alias("target"))


def copy_data(objects: DataFrame, offset: int, size: int) -> DataFrame:
    """path, data: a bounded read."""
    inside = F.octet_length("content") >= offset + size
    return objects.select("path", F.when(inside, F.substring("content", offset + 1, size)).otherwise(F.raise_error(F.lit("read beyond the end")).cast("binary")).alias("data"))


def source_lines(ranges: DataFrame) -> DataFrame:
    """file, line, col, ranges (sorted). ranges: file, line, col, start, end."""
    return ranges.groupBy("file", "line", "col").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges"))


def label_sites(labels: DataFrame, bodies: DataFrame, prefix: str) -> DataFrame:
    """fn, addr, local of call-site labels. labels: name, addr; bodies: fn, low, high, of functions and of what is inlined in them. The outermost body that holds the address counts."""
    from ..operators.ordered import nested

    found = labels.where(F.col("name").startswith(prefix)).select("addr", F.substring("name", len(prefix) + 1, 20).cast("int").alias("local"))
    return nested(found, "addr", bodies.select("fn", "low", "high"), "low", "high", outermost=True).where("fn IS NOT NULL").select("fn", "addr", "local")


def inline_edges(inlined: DataFrame, bodies: DataFrame) -> DataFrame:
    """inliner (the least address of the function's bodies), name: what is inlined where. inlined: name (null where there is none), addr; bodies: fn, low, high."""
    from ..operators.ordered import nested

    first = bodies.where("low < high").groupBy("fn").agg(F.min("low").alias("inliner"))
    found = nested(inlined.where("name IS NOT NULL"), "addr", bodies.select("fn", "low", "high"), "low", "high", outermost=True)
    return found.join(first, "fn").select("inliner", "name").distinct()
