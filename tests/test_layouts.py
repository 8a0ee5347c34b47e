"""Record layouts: sizes and offsets as C has them, and a round trip of every kind."""

import ctypes
import random
from decimal import Decimal

import pytest

from sparkreach.sources import binary, layouts
from sparkreach.sources.layouts import Array, Atomic, Enum, Flags, Int, Pointer, Struct

INNER = Struct((("a", Int(8)), ("b", Int(32, True)), ("c", Int(16))))
KIND, MARKS = Enum(("red", "green", "blue")), Flags(tuple(f"f{i}" for i in range(9)))
OUTER = Struct((("tag", Int(8, True)), ("in", INNER), ("far", Pointer()), ("list", Array(Int(16, True), 3)), ("kind", KIND), ("marks", MARKS), ("pairs", Array(INNER, 2)), ("count", Atomic(Int(64))), ("low", Int(64, True)), ("last", Int(8))))


class CInner(ctypes.Structure):
    _fields_ = [("a", ctypes.c_uint8), ("b", ctypes.c_int32), ("c", ctypes.c_uint16)]


class COuter(ctypes.Structure):
    _fields_ = [("tag", ctypes.c_int8), ("in", CInner), ("far", ctypes.c_void_p), ("list", ctypes.c_int16 * 3), ("kind", ctypes.c_uint8), ("marks", ctypes.c_uint16), ("pairs", CInner * 2), ("count", ctypes.c_uint64), ("low", ctypes.c_int64), ("last", ctypes.c_uint8)]


def test_sizes():
    for mine, theirs in ((INNER, CInner), (OUTER, COuter)):
        assert (mine.size, mine.align) == (ctypes.sizeof(theirs), ctypes.alignment(theirs))
        assert mine.offsets == [getattr(theirs, n).offset for n, _ in mine.fields]
    assert layouts.PAGE.size == 16384 and layouts.SITE.size == 16 and layouts.EDGE.size == 16
    assert [Enum(("x",) * n).size for n in (1, 253, 254, 255)] == [1, 1, 1, 2] and [Flags(("x",) * n).size for n in (7, 8, 15, 16, 31, 32)] == [1, 2, 2, 4, 4, 8]


def inner(rng):
    return {"a": rng.randrange(256), "b": rng.randrange(-(1 << 31), 1 << 31), "c": rng.randrange(1 << 16)}


def outer(rng):
    return {"tag": rng.randrange(-128, 128), "in": inner(rng), "far": rng.choice([0, (1 << 64) - 1, rng.randrange(1 << 64)]), "list": [rng.randrange(-(1 << 15), 1 << 15) for _ in range(3)], "kind": rng.choice([None, *KIND.names]), "marks": {n for n in MARKS.names if rng.random() < 0.5}, "pairs": [inner(rng), inner(rng)], "count": rng.randrange(1 << 64), "low": rng.randrange(-(1 << 63), 1 << 63), "last": rng.randrange(256)}


def test_round_trip(spark, tmp_path):
    rng = random.Random(3)
    values = [outer(rng) for _ in range(300)]
    (tmp_path / "x").write_bytes(b"".join(map(OUTER.pack, values)) + b"tail")
    (tmp_path / "y").write_bytes(b"")
    rows = layouts.records(binary.files(spark, str(tmp_path)), OUTER).orderBy("number").collect()
    assert len(rows) == 300
    for r, v in zip(rows, values, strict=True):
        got = {k: x for k, x in r.asDict(recursive=True).items() if k not in ("path", "number")}
        assert got == {**v, "far": Decimal(v["far"]), "count": Decimal(v["count"]), "marks": sum(1 << int(n[1:]) for n in v["marks"])}
    assert {r["number"] for r in layouts.records(binary.files(spark, str(tmp_path)), OUTER).where(MARKS.has("marks", "f8")).collect()} == {i for i, v in enumerate(values) if "f8" in v["marks"]}
    again = layouts.packed(layouts.records(binary.files(spark, str(tmp_path)), INNER).where("number < 5"), INNER)
    raw = (tmp_path / "x").read_bytes()
    masked = [INNER.pack({n: x[n] for n in ("a", "b", "c")}) for x in (layouts.records(binary.files(spark, str(tmp_path / "x")), INNER).where("number < 5").orderBy("number").collect())]
    assert sorted(bytes(r["value"]) for r in again.collect()) == sorted(masked) and len(raw) > 0


def test_bad_values(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"\x09")
    with pytest.raises(Exception, match="9 is none of"):
        layouts.records(binary.files(spark, str(tmp_path)), Struct((("kind", KIND),))).collect()
    with pytest.raises(ValueError, match="2 values for 3 places"):
        Array(Int(8), 3).pack([1, 2])


def test_dlsym_pages(spark, tmp_path):
    page = lambda n, *p: layouts.PAGE.pack({"next": n, "count": len(p), "pointers": [*p, *[77] * (layouts.PAGE_POINTERS - len(p))]})
    (tmp_path / "log-0x10000.bin").write_bytes(page(0x10000 + 16384, 5, 0, 6) + page(0, 7))
    pages = binary.read_dlsym_pages(spark, str(tmp_path))
    heads = spark.createDataFrame([(0x10000,)], "page bigint").selectExpr("cast(page as decimal(20,0)) AS page")
    assert {int(r["pointer"]) for r in binary.dlsym_pointers(pages, heads).collect()} == {5, 6, 7}
