"""Readers of text and binary facts, and the trace stream."""

import gzip
import json
import struct

import pytest

from sparkreach.sources import binary, facts
from sparkreach.streaming import traces


def test_relations(spark, tmp_path):
    (tmp_path / "0x10").mkdir()
    (tmp_path / "0x10" / "Call.facts").write_text("0x1:0x0001\t0x2\n\n0x1:0x0002\t0x3\t2\n")
    (tmp_path / "0x10" / "function-name.txt").write_text("main\n")
    rows = facts.read_by_function(spark, str(tmp_path), "Call").collect()
    assert {(r["callsite"], r["callee"], r["nargs"], r["fn"]) for r in rows} == {("0x1:0x0001", "0x2", None, "0x10"), ("0x1:0x0002", "0x3", 2, "0x10")}
    assert [tuple(r) for r in facts.function_names(spark, str(tmp_path)).collect()] == [("main", "0x10")]
    (tmp_path / "packed").write_bytes(gzip.compress(b"0x1\t0x2\n"))
    assert [tuple(r) for r in facts.read_gzip_sniffed(spark, str(tmp_path / "packed"), "Assign").collect()] == [("0x1", "0x2")]


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"vulnerabilities": [{"cve-id": "X", "package-name": "z", "package-version": "<2", "affected-function": "f", "waypoint-syms": ["g"]}]}))
    row = facts.read_vulnerabilities(spark, str(tmp_path / "v.json")).first()
    assert row["cve_id"] == "X" and row["waypoint_syms"] == ["g"] and row["additional_required_syms"] == []
    (tmp_path / "cg").write_text("a\t1\tb\nshort\tx\n")
    assert [tuple(r) for r in facts.read_call_graph(spark, str(tmp_path / "cg")).collect()] == [("a", "1", "b")]
    (tmp_path / "pts").write_text("0x10,-,0x20,0x3\n")
    row = facts.read_points_to(spark, str(tmp_path / "pts")).first()
    assert tuple(row["src"]) == (16, None) and tuple(row["dst"]) == (32, 3)
    (tmp_path / "bad").write_text("nonsense\n")
    with pytest.raises(Exception, match="not a points-to row"):
        facts.read_points_to(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "t.json").write_text(json.dumps({"a.c": {"component": "z", "version": "1"}}))
    assert [tuple(r) for r in facts.read_file_table(spark, str(tmp_path / "t.json")).collect()] == [("a.c", "z", "1")]


def test_traces(spark, tmp_path):
    (tmp_path / "trace-1").write_bytes(struct.pack("<6Q", 9, 5, 0, 7, 2**64 - 1, 2**63) + b"tail")
    got = {tuple(int(x) for x in r) for r in binary.read_traces(spark, str(tmp_path / "trace-1")).collect()}
    assert got == {(8, 5), (2**64 - 2, 2**63)}
    (tmp_path / "sites-0x1000").write_bytes(struct.pack("<QII", 77, 3, 0) * 2)
    got = {tuple(int(x) for x in r) for r in binary.read_trace_sites(spark, str(tmp_path / "sites-0x1000")).collect()}
    assert got == {(4096, 77, 3), (4112, 77, 3)}


def test_dlsym_chain(spark):
    pages = spark.createDataFrame([(1, 2, 2, [10, 0, 99]), (2, 0, 1, [20, 30, 0])], "page bigint, next bigint, count bigint, pointers array<bigint>")
    heads = spark.createDataFrame([(1,)], "page bigint")
    assert {r["pointer"] for r in binary.dlsym_pointers(pages, heads).collect()} == {10, 20}


def test_stream_and_words(spark, tmp_path):
    spark.createDataFrame([(i, i % 3) for i in range(40)], "event_id bigint, user_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in traces.dedup_stream(spark, f"{tmp_path}/events.parquet").collect()}
    assert got == {((i % 3 + 1) * 2, i % 50) for i in range(40)}
    buffers = spark.createDataFrame([(1, struct.pack("<2Q", 5, 2**64 - 1) + b"x"), (2, b"")], "site bigint, data binary")
    assert {(r["site"], int(r["val"])) for r in traces.words(buffers).collect()} == {(1, 5), (1, 2**64 - 1)}
    values = spark.createDataFrame([(1, 1, 15), (1, 1, 55), (1, 1, 99)], "site bigint, ts bigint, val bigint")
    segments, slots = spark.createDataFrame([(0, 10, 20)], "since bigint, lo bigint, hi bigint"), spark.createDataFrame([(50, 10)], "start bigint, size bigint")
    tags = spark.createDataFrame([(50, 0, 7)], "start bigint, since bigint, tag bigint")
    assert {r["as_value"] for r in traces.classify(values, segments, slots, tags).collect()} == {15, 7}
