"""Graph frames: numbers, objects, relocations, hard cases, and random graphs through Spark."""

import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkreach.sources import frames


def function(fn, edges=(), names=(), num_allocas=0, component=None, version=None):
    keys = ("rel", "to_symbol", "to_local", "from_symbol", "from_local", "idx")
    return {"fn": fn, "component": component, "version": version, "num_allocas": num_allocas, "names": list(names), "edges": [dict(zip(keys, e, strict=True)) for e in edges]}


def rows(df):
    return {tuple(r)[1:] for r in df.collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300))
def test_numbers(xs):
    x = np.array(xs, np.uint32)
    assert frames.unpack_numbers(frames.pack_numbers(x), len(xs)).tolist() == xs
    assert frames.unzigzag(frames.zigzag(x)).tolist() == xs


def test_stream_layout():
    # lengths of four numbers in a byte, the first lowest, then the bytes
    assert frames.pack_numbers(np.array([1, 0x100, 0x10000, 0x1000000, 5])) == bytes([0b11100100, 0, 1, 0, 1, 0, 0, 1, 0, 0, 0, 1, 5])
    assert frames.HEADER.size == 40
    with pytest.raises(ValueError, match="take"):
        frames.unpack_numbers(b"\0\1\2", 1)


def test_small_graphs(spark, tmp_path):
    one = function(100, [("Assign", 100, 1, 100, 0, None), ("Assign", 100, 2, 200, None, None), ("ArgumentDefinition", 100, 0, 100, None, 23), ("Return", 100, None, 100, 2, None)], ["a", "", "a"], 1, "zlib", "1.2")
    two = function(200, [("Call", 200, 0, 100, None, 2)], ["b"], 0, "zlib", None)
    (tmp_path / "one").write_bytes(frames.image([[one, two], [function(300)], []]))
    (tmp_path / "none").write_bytes(frames.image([]))
    found = frames.read_frames(spark, str(tmp_path))
    assert sorted(r["frame"] for r in found.collect()) == [0, 1, 2]
    assert rows(frames.edges(found)) == {(f["fn"], *e.values()) for f in (one, two) for e in f["edges"]}
    assert rows(frames.functions(found)) == {(100, 3, 1, "zlib", "1.2"), (200, 1, 0, None, None), (300, 0, 0, None, None)}
    assert rows(frames.local_names(found)) == {(100, 0, "a"), (100, 1, ""), (100, 2, "a"), (200, 0, "b")}


def test_random_graphs(spark, tmp_path):
    rng = random.Random(5)
    names, expected = [f"n{i}" for i in range(9)], set()
    for obj in range(3):
        units = []
        for unit in range(4):
            out = []
            for i in range(16):
                fn = 0x7F0000000000 + (obj * 4 + unit) * 1000 + i
                end = lambda fn=fn: (rng.randrange(0x7F0000000000, 0x7F0000001000), None) if rng.random() < 0.25 else (fn, rng.randrange(32))
                edges = [(rel, *end(), *end(), rng.randrange(512) if rel in frames.INDEXED else None) for rel in frames.RELATIONS for _ in range(rng.randrange(32))]
                out.append(function(fn, edges, rng.choices(names, k=32), rng.randrange(33)))
                expected |= {(fn, *e) for e in edges}
            units.append(out)
        (tmp_path / f"o{obj}").write_bytes(frames.image(units))
    assert rows(frames.edges(frames.read_frames(spark, str(tmp_path), spread=True))) == expected


def test_bytes_between_and_ends():
    data = bytearray(frames.image([[function(1)]]))
    at = data.find(frames.MAGIC)
    assert len(list(frames.cut(bytes(data)))) == 1
    struct.pack_into("<I", data, at + 8, 1 << 20)  # the stream's size
    with pytest.raises(ValueError, match="ends early"):
        list(frames.cut(bytes(data)))
    data[at : at + 8] = b"padding."
    assert not list(frames.cut(bytes(data)))


def test_damaged_frames():
    (frame,) = frames.cut(frames.image([[function(7, [("Assign", 7, 0, 7, 1, None)], ["a", "b"])]]))
    keys = ("frame", "strings_size", "has_locals", "num_locals", "num_functions", "num_words", "symbols", "functions", "debug")
    good = {"path": "p", **dict(zip(keys, frame, strict=True))}
    assert len(list(frames.walk(good))) == 1
    for change in ({"num_functions": 2}, {"num_words": 3}, {"strings_size": 2}):
        with pytest.raises(ValueError):
            frames.strings(good | change), list(frames.walk(good | change))
    with pytest.raises(IndexError):
        list(frames.walk(good | {"symbols": []}))


def test_relocations_by_symbol():
    table = bytes(24) + struct.pack("<IBBHQQ", 0, 0, 0, 1, 5000, 0)
    rela = struct.pack("<QQq", 64, 1 << 32 | 1, 16) + struct.pack("<QQq", 32, 8, 77) + struct.pack("<QQq", 40, 99, 5) + struct.pack("<QQq", 72, 1027, 78) + struct.pack("<QQq", 80, 1 << 32 | 257, -8)
    sections = [("", 0, 0, 0, 0, 0, 0), (".dynsym", 11, 0, 0, 48, 0, 24), (".rela", 4, 0, 48, 120, 1, 24)]
    p = frames.Pointers(table + rela, sections)
    assert p.at(32, np.array([1, 2, 3, 4, 5], np.uint64)).tolist() == [77, 2, 3, 4, 5016]
    assert p.at(72, np.array([0, 0], np.uint64)).tolist() == [78, 4992]
