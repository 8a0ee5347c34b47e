"""Nodes, versions and names against plain Python."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkreach.functions import names, nodes, versions


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_node_words(spark):
    rows = [(0, None), (0, 0), (5, 65534), ((1 << 40) + 3, 7), ((1 << 48) - 2, 1)]
    df = spark.createDataFrame(rows, "s bigint, l int").withColumn("w", nodes.pack(F.col("s"), F.col("l")))
    back = df.select("s", "l", "w", nodes.symbol_of(F.col("w")).alias("s2"), nodes.local_of(F.col("w")).alias("l2")).collect()
    for r in back:
        assert (r["s"], r["l"]) == (r["s2"], r["l2"])
        assert r["w"] % (1 << 64) == ((r["s"] + 1) << 16) + (0 if r["l"] is None else r["l"] + 1)


def test_node_out_of_range(spark):
    with pytest.raises(Exception, match="out of range"):
        one(spark, 1 << 49, "bigint", nodes.pack)


def test_node_text(spark):
    df = spark.createDataFrame([(255, 16), (0, None)], "s bigint, l int").withColumn("t", nodes.text(F.col("s"), F.col("l")))
    got = df.select("t", nodes.from_text(F.col("t")).alias("n"), nodes.symbol_text(F.col("t")).alias("o")).collect()
    assert got[0]["t"] == "0x00000000000000ff:0x0010" and tuple(got[0]["n"]) == (255, 16) and got[0]["o"] == "0x00000000000000ff"
    assert got[1]["t"] == "0x0000000000000000" and tuple(got[1]["n"]) == (0, None)
    with pytest.raises(Exception, match="not a node"):
        one(spark, "0x1:0x2:0x3", "string", nodes.from_text)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-(2**31), 2**31 - 1), min_size=1, max_size=200))
def test_zigzag(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x bigint").select("x", nodes.zigzag(F.col("x")).alias("z"))
    for r in df.select("x", "z", nodes.unzigzag(F.col("z")).alias("y")).collect():
        assert r["y"] == r["x"] and r["z"] == (r["x"] << 1 ^ r["x"] >> 63) and r["z"] >= 0


def test_location_and_stars(spark):
    at = one(spark, "a/b.c:12:3|name@[inlined]", "string", nodes.location)
    assert tuple(at) == ("a/b.c", 12, 3, "name")
    assert one(spark, "a/b.c:0:3|name", "string", nodes.location) is None
    assert [one(spark, n, "int", lambda c: nodes.starred(F.lit("v"), c)) for n in (0, 1, 2, 3)] == ["v", "*v", "**v", "$***v"]
    assert [one(spark, s, "string", nodes.normal_symbol) for s in ("f", "a -> b", "*f", ".L1")] == [True, False, False, False]


ORDERED = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.2", "1.10.0", "2"]


def test_version_order(spark):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(ORDERED)], "v string, i int")
    assert [r["v"] for r in df.orderBy(versions.parse(F.col("v"))).collect()] == ORDERED


def test_version_forms(spark):
    for text, ok in (("v1.2.3", True), ("1.2.12#2", True), ("1", True), ("1.2.3+build", True), ("1.2.3.4", False), ("01.2.3", False), ("x", False), (None, False)):
        assert (one(spark, text, "string", versions.parse) is not None) == ok, text


@pytest.mark.parametrize(
    ("version", "ranges", "inside"),
    [("1.5.3", "<=1.5.3", True), ("1.6.0", "<=1.5.3", False), ("1.0.0", ">=0.3.0|<1.2.0", True), ("1.2.0", ">=0.3.0|<1.2.0", False), ("2.4.1", "=2.4.1", True), ("2.4.1", "2.4.1", True), ("3.0.0", ">=1.0.0|<2.0.0|>=2.5.0|<4.0.0", True), ("2.2.0", ">=1.0.0|<2.0.0|>=2.5.0|<4.0.0", False), ("9.0.0", ">1.0.0", True), ("1.2.0-rc.1", ">=1.2.0", False), ("x.y", ">1.0.0", None)],
)
def test_ranges(spark, version, ranges, inside):
    df = spark.createDataFrame([(version, ranges)], "v string, r string")
    assert df.select(versions.satisfies(F.col("v"), F.col("r")).alias("y")).first()["y"] is inside


def test_bad_range(spark):
    df = spark.createDataFrame([("1.0.0", ">=zzz")], "v string, r string")
    with pytest.raises(Exception, match="bad version in a range"):
        df.select(versions.satisfies(F.col("v"), F.col("r"))).collect()


@pytest.mark.parametrize(
    ("mangled", "short"),
    [("main", "main"), ("_Z3foov", "foo"), ("_ZN3foo3barEi", "bar"), ("_ZNK3foo3bazEv", "baz"), ("_ZN3FooC2Ev", "Foo"), ("_ZN3FooD1Ev", "~Foo"), ("_ZN3FooplERKS_", "operator+"), ("_ZN1AIiE1fEv", "f"), ("_ZSt4moveIiEvT_", "move"), ("_Z", None), ("_Z99x", None), (None, None)],
)
def test_short_names(mangled, short):
    assert names.short_name(mangled) == short


def test_text_helpers(spark):
    assert one(spark, "a--b c", "string", names.identifier) == "a_b_c"
    assert one(spark, "/src/x/y.c", "string", lambda c: names.map_prefix(c, [("/src/", "repo/"), ("/", "root/")])) == "repo/x/y.c"
    assert one(spark, "/r/a.c", "string", lambda c: names.relative(c, "/r")) == "a.c"
    assert tuple(one(spark, "int f(int a, char *b)", "string", names.override_arity)) == ("f", 2)
    assert tuple(one(spark, "void g(void)", "string", names.override_arity)) == ("g", 0)
    assert one(spark, "inc/zlib_conf.h", "string", names.include_port) == ["zlib_conf", "zlib", "inc"]
