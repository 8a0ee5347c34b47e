"""Headers' ports, files of results and the texts in them, with their hard cases."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkreach.functions import names
from sparkreach.operators import facts, reports, triage
from sparkreach.sources import headers, sinks


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_include_roots(spark):
    calls = [["cc", "-I", "/a/include", "-I/b//c/./d/", "-isystem", "rel/include"], ["--include-directory", "/a"], ["x.c", "-I"], [], ["-isystem"], None]
    found = headers.include_roots(spark.createDataFrame([(c,) for c in calls], "args array<string>"), "/work")
    assert rows(found) == {("/a",), ("/b/c/d",), ("/work/rel",)}


def document(*packages):
    return json.dumps({"packages": [{"SPDXID": i, "name": n, "versionInfo": v} for i, n, v in packages]})


def test_header_tree(spark, tmp_path):
    files = {
        "r/include/zlib.h": "", "r/include/png_conf.hpp": "", "r/include/ssl/x.h": "", "r/include/ssl/deep/zlib.h": "", "r/include/none.h": "", "r/include/zlib.c": "",
        "r/share/zlib/vcpkg.spdx.json": document(("SPDXRef-resource", "none", "9"), (headers.PORT, "zlib", "1.2")),
        "r/share/z2/vcpkg.spdx.json": document((headers.PORT, "zlib", "1.3")),
        "r/share/png/vcpkg.spdx.json": document((headers.PORT, "png", None), (headers.PORT, None, "1")),
        "r/share/ssl/vcpkg.spdx.json": document((headers.PORT, "ssl", "3")),
        "r/share/bad/vcpkg.spdx.json": "{not json",
        "r/doc/none/vcpkg.spdx.json": document((headers.PORT, "none", "1")),
        "r/a/include/zlib.h": "",
        "r/a/share/zlib/vcpkg.spdx.json": document((headers.PORT, "zlib", "0.9")),
        "other/include/zlib.h": "",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text or "//")
    root = str(tmp_path)
    tree, documents = headers.read_trees(spark, [root])
    roots = spark.createDataFrame([(f"{root}/{r}",) for r in ("r", "r/a", "other")], "root string")
    found = headers.header_ports(tree, headers.port_packages(documents, roots), roots)
    expected = {("r/include/zlib.h", "zlib", "1.2"), ("r/include/png_conf.hpp", "png", None), ("r/include/ssl/x.h", "ssl", "3"), ("r/include/ssl/deep/zlib.h", "zlib", "1.2"), ("r/a/include/zlib.h", "zlib", "0.9")}
    assert {(f.removeprefix(root + "/"), n, v) for f, n, v in rows(found)} == expected
    none = headers.header_ports(tree.limit(0), headers.port_packages(documents, roots), roots)
    assert rows(none) == set()

    one = headers.publish(headers.sbom_lines(found), f"{root}/out", "sbom")
    two = headers.publish(headers.sbom_lines(found.orderBy("file")).repartition(3), f"{root}/out", "sbom")
    assert one == two and os.listdir(f"{root}/out") == [os.path.basename(one)]
    assert rows(headers.read_sbom(spark, one)) == rows(found)
    assert headers.publish(headers.sbom_lines(found.where("name <> 'ssl'")), f"{root}/out", "sbom") != one


def test_missing(spark, tmp_path):
    symbols = spark.createDataFrame([(16, "_ZN3foo3barEv", 8), (32, "main", 4), (64, "_Z", 1)], "addr bigint, name string, size bigint")
    functions = spark.createDataFrame([(16,), (20,), (24,), (32,), (64,)], "addr bigint")
    sinks.write_missing(sinks.named(functions, symbols), f"{tmp_path}/m")
    assert "0x0000000000000010\t_ZN3foo3barEv" in spark.read.text(f"{tmp_path}/m").toPandas()["value"].tolist()
    expected = {(16, "_ZN3foo3barEv", "bar"), (20, "_ZN3foo3barEv", "bar"), (24, "<unknown>", "<unknown>"), (32, "main", "main"), (64, "_Z", "<invalid>")}
    assert rows(sinks.missing_report(sinks.read_missing(spark, f"{tmp_path}/m"))) == expected


def test_reachable(spark, tmp_path):
    sinks.write_reachable(spark.createDataFrame([("255",), ("0xFF",), ("i32 (i8*)",), ("0x10:0x0001",), ("",)], "node string"), f"{tmp_path}/r")
    found, other = sinks.read_reachable(spark, f"{tmp_path}/r")
    assert rows(found) == {(255,)} and rows(other) == {("i32 (i8*)",), ("",)}


def test_slice(spark, tmp_path):
    calls = spark.createDataFrame([("0x1:0x1", "0x2", "Direct"), ("0x2:0x1", "0x3", "Indirect"), ("0x2:0x2", "0x3", "Direct"), ("0x3", "0x9", "Direct"), ("0x8", "0x3", "Direct"), ("0x2", "0x2", "Direct")], "src string, dst string, kind string")
    known = spark.createDataFrame([("0x1", "main"), ("0x3", 'say "hi"')], "node string, name string")
    sinks.write_lines(sinks.slice_lines(calls, known, "main", 'say "hi"'), f"{tmp_path}/dot")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/dot").orderBy(F.input_file_name(), F.monotonically_increasing_id()).collect()]
    assert lines[0] == "digraph {" and lines[-1] == "}"
    assert sorted(lines[1:-1]) == ['  "0x2" -> "0x2";', '  "0x2" -> "say \\"hi\\"";', '  "main" -> "0x2";']


def test_comparison(spark, tmp_path):
    run = lambda tests: spark.createDataFrame([(n, {"compile_time": t}) for n, t in tests], "name string, metrics map<string,double>")
    found = sinks.comparison(run([("a", 3.0), ("b", 1.0), ("c", 1.0)]), run([("a", 2.0), ("b", 0.0), ("d", 5.0)]), "compile_time")
    assert rows(found) == {("a", 3.0, 2.0, 50.0), ("b", 1.0, 0.0, None), ("c", 1.0, None, None)}
    sinks.write_comparison(found, f"{tmp_path}/c", "new", "old")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["Testcase", "new", "old", "Percentage change from n2"]


def test_local_names(spark):
    given = [(1, 0, "a"), (1, 1, "x|a"), (1, 2, "a_1"), (1, 3, "a"), (1, 4, "b--c"), (1, 5, "p"), (1, 5, "q"), (2, 0, "a"), (2, 0, "a")]
    found = names.local_names(spark.createDataFrame(given, "fn bigint, local bigint, debug string"))
    assert rows(found) == {(1, 0, "LOCALa"), (1, 1, "LOCALa_1"), (1, 2, "LOCALa_1_1"), (1, 3, "LOCALa_1_1_1"), (1, 4, "LOCALb_c"), (2, 0, "LOCALa")}


@pytest.mark.parametrize(("values", "text"), [([], "NULL"), (["a"], "a"), (["a", "b", "c"], "NONDET_SELECT(NONDET_SELECT(a, b), c)")])
def test_chosen(spark, values, text):
    assert spark.createDataFrame([(values,)], "v array<string>").select(names.chosen(F.col("v"))).first()[0] == text


def test_texts(spark):
    text = "Target function f is present. Target function of zlib. " + names.NO_SYMBOLS + " \n"
    df = spark.createDataFrame([(text,), ("nothing",), ("",)], "t string")
    assert [tuple(r) for r in df.select(names.target_function(F.col("t")), names.report_text(F.col("t"))).collect()] == [("f", "Vulnerable function f is present. Vulnerable function of zlib."), ("Unknown Target", "nothing"), ("Unknown Target", "")]
    back = spark.createDataFrame([("node_ffx",), ("node_zzx",), ("node_x",), ("main",)], "n string").select(names.name_address(F.col("n")))
    assert [r[0] for r in back.collect()] == [255, None, None, None]


def test_fact_graph(spark):
    edges = spark.createDataFrame([("Assign", "a", "b", None), ("Call", "a", 'q"', 3)], "rel string, dst string, src string, idx bigint")
    known = spark.createDataFrame([("a", "A (rnd=12)"), ("b", "B"), ("b", "B")], "node string, name string")
    sub = spark.createDataFrame([("b", "a"), ("b", "0x1:0x2"), ("b", "a")], "dst string, src string")
    found = [r["line"] for r in reports.fact_graph(edges, known, sub).orderBy("pos", "line").collect()]
    assert found == ["digraph {", '"a" [label="A" class="CHILDclass-b" id="class-a"];', '"b" [label="B" class="PARENTclass-0x1_0x2 PARENTclass-a" id="class-b"];', '"b" -> "a" [label="Assign"];', '"q\\"" -> "a" [label="Call (3)"];', "}"]


def test_sarif_log(spark):
    form = "cve_id string, result string"
    whole = lambda rows: json.loads("".join(r["line"] for r in reports.sarif_log(spark.createDataFrame(rows, form)).orderBy("pos", "line").collect()))
    assert whole([])["runs"][0]["results"] == []
    assert whole([("b", '{"x":1}'), ("a", '{"x":2}'), ("a", '{"x":2}'), ("a", '{"x":3}')])["runs"][0]["results"] == [{"x": 2}, {"x": 1}, {"x": 2}, {"x": 3}]


def test_differences(spark):
    one = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "k int, v string")
    two = spark.createDataFrame([("a", 1), (None, 2), ("d", 3)], "v string, k int")
    assert rows(facts.differences(one, two)) == {(3, "c", "first"), (3, "d", "second")}
    assert rows(facts.differences(one, one)) == set()


def test_to_analyse(spark):
    given = [(triage.POSSIBLE, 1), (triage.POSSIBLE, None), (triage.UNREACHABLE, 2), (triage.UNKNOWN, 3), (None, 4)]
    taken, rest = triage.to_analyse(spark.createDataFrame(given, "classification string, address bigint"))
    assert rows(taken) == {given[0], given[4]} and rows(rest) == set(given[1:4])
