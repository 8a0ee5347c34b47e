"""Graph frames: the edge graphs that object files carry in a section of their own, read and written.

A frame is a header, pointers to the frame's debug data and symbols, and a zstd-compressed stream of variable-length
32-bit numbers; debug data are strings and the names of locals. Objects are cut into frames in the task that reads them,
frames are decoded in Arrow batches: the walk is a step a function and relation, edges are decoded as arrays. Pointers
are resolved by the object's relocations.

Cases: an object without the section, or with none but zero bytes in it, has no frames; bytes between frames are
skipped; a frame that ends early, a symbol or string out of range and a stream of the wrong length are errors; strings
that are not UTF-8 are read with replacements.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .binary import elf_sections, files
from .layouts import Array, Int, Struct

# fixed values: section names, magic numbers, the header's fields, the relations in the order of the stream
GRAPH, DEBUG = "GR_graph_edges", "GR_graph_debug"
MAGIC = struct.pack("<2I", 0x3AC73B4E, 0x445ECF19)
HEADER = Struct((
    ("magic", Array(Int(32), 2)),
    ("functions_size", Int(32)), ("debug_size", Int(32)), ("num_symbols", Int(32)), ("strings_size", Int(32)),
    ("has_locals", Int(32)), ("num_locals", Int(32)), ("num_functions", Int(32)), ("num_words", Int(32)),
))
RELATIONS = ("Assign", "Load", "Store", "Call", "Return", "ArgumentDefinition", "ArgumentSupply", "Dlsym")
INDEXED = ("Call", "ArgumentDefinition", "ArgumentSupply")

# fixed values: relocations that hold an address alone, and those that add a symbol's, on x86-64 and AArch64
RELATIVE, ABSOLUTE = (8, 1027), (1, 6, 257, 1025)

FRAME = "path string, frame int, strings_size bigint, has_locals boolean, num_locals bigint, num_functions bigint, num_words bigint, symbols array<bigint>, functions binary, debug binary"
EDGE = "path string, fn bigint, rel string, to_symbol bigint, to_local bigint, from_symbol bigint, from_local bigint, idx bigint"
FUNCTION = "path string, fn bigint, num_locals bigint, num_allocas bigint, component string, version string"
LOCAL = "path string, fn bigint, local bigint, name string"


# ---- numbers


def pack_numbers(x: np.ndarray) -> bytes:
    """Two bits of length for each number, four to a byte, then the numbers' bytes."""
    x = np.asarray(x, np.uint32)
    size = 1 + (x > 0xFF).astype(np.uint8) + (x > 0xFFFF) + (x > 0xFFFFFF)
    padded = np.concatenate((size - 1, np.zeros(-len(x) % 4, np.uint8))).reshape(-1, 4).astype(np.uint8)
    control = padded[:, 0] | padded[:, 1] << 2 | padded[:, 2] << 4 | padded[:, 3] << 6
    raw = x.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes() + raw[np.arange(4) < size[:, None]].tobytes()


def unpack_numbers(data: bytes, n: int) -> np.ndarray:
    if len(data) < (n + 3) // 4:
        raise ValueError(f"{len(data)} bytes are too few for {n} numbers")
    control = np.frombuffer(data, np.uint8, (n + 3) // 4)
    size = (np.stack([control >> s & 3 for s in (0, 2, 4, 6)], axis=1).ravel()[:n] + 1).astype(np.int64)
    if len(control) + size.sum() != len(data):
        raise ValueError(f"{n} numbers take {len(control) + size.sum()} bytes, not {len(data)}")
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8, offset=len(control))
    return out.view("<u4").ravel()


def zigzag(x: np.ndarray) -> np.ndarray:
    """Differences of 32-bit numbers as small unsigned ones."""
    d = np.diff(x.astype(np.uint32), prepend=np.uint32(0)).view(np.int32)
    return (d << 1 ^ d >> 31).view(np.uint32)


def unzigzag(x: np.ndarray) -> np.ndarray:
    return np.cumsum((x >> 1) ^ (np.uint32(0) - (x & 1)), dtype=np.uint32)


# ---- objects


class Pointers:
    """Slots of an object's relocations and where they point, by bisection."""

    def __init__(self, data: bytes, sections: list[tuple]):
        slots, targets = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for _, kind, _, offset, size, link, _ in sections:
            if kind != 4:
                continue
            entries = np.frombuffer(data, np.dtype([("slot", "<u8"), ("kind", "<u4"), ("symbol", "<u4"), ("add", "<i8")]), size // 24, offset)
            target = entries["add"].astype(np.uint64)
            named = np.isin(entries["kind"], ABSOLUTE)
            if named.any():
                table = sections[link]
                values = np.frombuffer(data, np.dtype([("", "V8"), ("value", "<u8"), ("", "V8")]), table[4] // 24, table[3])["value"]
                target[named] += values[entries["symbol"][named]]
            kept = named | np.isin(entries["kind"], RELATIVE)
            slots.append(entries["slot"][kept])
            targets.append(target[kept])
        slots, targets = np.concatenate(slots), np.concatenate(targets)
        order = np.argsort(slots, kind="stable")
        self.slots, self.targets = slots[order], targets[order]

    def at(self, first: int, stored: np.ndarray) -> np.ndarray:
        """The pointers stored from address `first` on; those without relocation are as stored."""
        places = np.uint64(first) + np.arange(len(stored), dtype=np.uint64) * np.uint64(8)
        if not len(self.slots):
            return stored
        i = np.searchsorted(self.slots, places).clip(max=len(self.slots) - 1)
        return np.where(self.slots[i] == places, self.targets[i], stored)


def cut(data: bytes) -> Iterator[tuple]:
    """frame and the further columns of FRAME of each frame of an object."""
    sections = elf_sections(data)
    pointers, number = Pointers(data, sections), 0
    for name, _, start, offset, size, *_ in sections:
        if name != GRAPH:
            continue
        end, at = offset + size, data.find(MAGIC, offset, offset + size)
        while at >= 0:
            after = at + HEADER.size + 8
            if after > end:
                raise ValueError(f"frame {number} ends early")
            h = np.frombuffer(data, HEADER.dtype, 1, at)[0]
            body = after + 8 * int(h["num_symbols"])
            if body + int(h["functions_size"]) > end:
                raise ValueError(f"frame {number} ends early")
            address = start + at - offset + HEADER.size
            debug, *symbols = pointers.at(address, np.frombuffer(data, "<u8", 1 + int(h["num_symbols"]), at + HEADER.size)).view(np.int64).tolist()
            at = body + int(h["functions_size"])
            fields = (int(h["strings_size"]), bool(h["has_locals"]), int(h["num_locals"]), int(h["num_functions"]), int(h["num_words"]))
            yield number, *fields, symbols, data[body:at], held(data, sections, debug, int(h["debug_size"]))
            number, at = number + 1, data.find(MAGIC, at, end)


def held(data: bytes, sections: list[tuple], address: int, size: int) -> bytes:
    """size bytes at an address, from the section that holds them all."""
    for _, kind, start, offset, length, *_ in sections:
        if kind != 8 and start and start <= address and address + size <= start + length:
            return data[offset + address - start : offset + address - start + size]
    raise ValueError(f"no section holds {size} bytes at {address:#x}")


def batches_of(df: DataFrame, rows, schema: str) -> DataFrame:
    """Rows of another schema from each row (a dict): one batch of Arrow columns a row, by a function that yields column lists."""
    names = re.findall(r"(\w+) \w", schema)
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    types = [kinds[t] for t in re.findall(r"\w+ ([\w<>]+)", schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}
                for columns in rows(row):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def read_frames(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """FRAME's columns, a row a frame of every object at path; functions and debug are still packed. spread: frames of one object go to many tasks, for few objects with many frames.

    An object is read whole, as binaryFile gives it: 2 GB at most.
    """
    found = batches_of(files(spark, path), lambda r: ([[r["path"]], *([x] for x in f)] for f in cut(r["content"])), FRAME)
    return found.repartition("path", "frame") if spread else found


# ---- frames


def walk(frame: dict) -> Iterator[tuple]:
    """fn, component, version (places of strings), locals, allocas, {rel: words of its edges} of each function."""
    x = unpack_numbers(zstandard.ZstdDecompressor().decompress(frame["functions"]), frame["num_words"])
    at = 0

    def take(n: int) -> np.ndarray:
        nonlocal at
        at += n
        if at > len(x):
            raise ValueError(f"the stream of {len(x)} words ends within a function")
        return x[at - n : at]

    for _ in range(frame["num_functions"]):
        symbol, component, version, num_locals, num_allocas = take(5).tolist()
        if num_allocas > num_locals:
            raise ValueError(f"{num_allocas} allocas of {num_locals} locals")
        edges = {}
        for rel in RELATIONS:
            width = 3 if rel in INDEXED else 2
            edges[rel] = take(int(take(1)[0]) * width).reshape(-1, width)
        yield frame["symbols"][symbol], component, version, num_locals, num_allocas, edges


def frame_edges(frame: dict) -> Iterator[list]:
    symbols = np.array(frame["symbols"], np.int64)
    for fn, _, _, _, _, edges in walk(frame):
        for rel, words in edges.items():
            n = len(words)
            if not n:
                continue
            ends = unzigzag(words[:, :2].ravel()).astype(np.int64)
            named = (ends & 1).astype(bool)
            symbol = np.full(2 * n, fn, np.int64)
            symbol[named] = symbols[ends[named] >> 1]
            local = pa.array(ends >> 1, mask=named)
            idx = words[:, 2].astype(np.int64) if rel in INDEXED else pa.nulls(n, pa.int64())
            yield [[frame["path"]] * n, np.full(n, fn), [rel] * n, symbol[::2], local.take(pa.array(np.arange(0, 2 * n, 2))), symbol[1::2], local.take(pa.array(np.arange(1, 2 * n, 2))), idx]


def edges(frames: DataFrame) -> DataFrame:
    """EDGE's columns: an end is a symbol, or a local of fn with its place."""
    return batches_of(frames, frame_edges, EDGE)


def strings(frame: dict) -> tuple[list[str], bytes]:
    """The strings of the debug data, and the bytes behind them."""
    data = zstandard.ZstdDecompressor().decompress(frame["debug"])
    n = frame["strings_size"]
    if n > len(data) or (n and data[n - 1]):
        raise ValueError("the strings do not end")
    return [s.decode(errors="replace") for s in data[:n].split(b"\0")[:-1]], data[n:]


def functions(frames: DataFrame) -> DataFrame:
    """FUNCTION's columns; component and version are null unless both are there."""

    def rows(frame: dict) -> Iterator[list]:
        text, _ = strings(frame)
        found = []
        for fn, c, v, num_locals, num_allocas, _ in walk(frame):
            both = text[c] and text[v]
            found.append((frame["path"], fn, num_locals, num_allocas, text[c] if both else None, text[v] if both else None))
        if found:
            yield list(zip(*found, strict=True))

    return batches_of(frames, rows, FUNCTION)


def local_names(frames: DataFrame) -> DataFrame:
    """LOCAL's columns, of frames that carry names; names of a frame's functions stand one behind the other."""

    def rows(frame: dict) -> Iterator[list]:
        if not frame["has_locals"]:
            return
        text, rest = strings(frame)
        places = np.cumsum(unpack_numbers(rest, frame["num_locals"]), dtype=np.uint32).tolist()
        at = 0
        for fn, _, _, n, _, _ in walk(frame):
            if at + n > len(places):
                raise ValueError(f"{len(places)} names for more locals")
            if n:
                yield [[frame["path"]] * n, [fn] * n, range(n), [text[p] for p in places[at : at + n]]]
            at += n

    return batches_of(frames, rows, LOCAL)


# ---- writing


def encode(functions: list[dict]) -> tuple[bytes, list[int], bytes]:
    """A frame with empty pointers, the addresses for its symbols, and its debug data.

    functions: fn, component, version, num_allocas, names (of all locals), edges (dicts with EDGE's columns from rel on).
    """
    symbols = sorted({f["fn"] for f in functions} | {e[k] for f in functions for e in f["edges"] for k in ("to_symbol", "from_symbol")})
    place = {s: i for i, s in enumerate(symbols)}
    string: dict[str, int] = {"": 0}
    number = lambda s: string.setdefault(s or "", len(string))
    word = lambda symbol, local: place[symbol] << 1 | 1 if local is None else local << 1
    stream, names = [], []
    for f in functions:
        stream.append(np.array([place[f["fn"]], number(f["component"]), number(f["version"]), len(f["names"]), f["num_allocas"] or 0], np.uint32))
        names += map(number, f["names"])
        for rel in RELATIONS:
            found = sorted((word(e["to_symbol"], e["to_local"]), word(e["from_symbol"], e["from_local"]), e["idx"] or 0) for e in f["edges"] if e["rel"] == rel)
            x = np.array(found, np.uint32).reshape(-1, 3)
            ends = zigzag(x[:, :2].ravel()).reshape(-1, 2)
            both = np.column_stack((ends, x[:, 2:])) if rel in INDEXED else ends
            stream += [np.array([len(x)], np.uint32), both.ravel()]
    words = np.concatenate(stream) if stream else np.zeros(0, np.uint32)
    blob = b"".join(s.encode() + b"\0" for s in string)
    pack = zstandard.ZstdCompressor(level=9).compress
    body = pack(pack_numbers(words))
    debug = pack(blob + pack_numbers(np.diff(np.array(names, np.uint32), prepend=np.uint32(0))))
    head = {"magic": struct.unpack("<2I", MAGIC), "functions_size": len(body), "debug_size": len(debug), "num_symbols": len(symbols), "strings_size": len(blob), "has_locals": 1, "num_locals": len(names), "num_functions": len(functions), "num_words": len(words)}
    return HEADER.pack(head) + bytes(8 * (1 + len(symbols))) + body, symbols, debug


def image(units: list[list[dict]], base: int = 0x1000) -> bytes:
    """A 64-bit object whose graph section has a frame a unit, all pointers as relocations."""
    graph, debug, slots, blobs = b"", b"", [], []
    for unit in units:
        frame, symbols, data = encode(unit)
        graph += bytes(-len(graph) % 8)
        slots += [(base + len(graph) + HEADER.size + 8 * i, s) for i, s in enumerate([None, *symbols])]
        blobs.append(len(debug))
        graph, debug = graph + frame, debug + data
    graph += bytes(-len(graph) % 8)
    at = iter(blobs)
    rela = b"".join(struct.pack("<QQq", slot, 8, base + len(graph) + next(at) if s is None else s) for slot, s in slots)
    parts = [(GRAPH, 1, base, graph), (DEBUG, 1, base + len(graph), debug), (".rela.dyn", 4, 0, rela)]
    names = b"\0" + b"".join(n.encode() + b"\0" for n, *_ in parts) + b".shstrtab\0"
    parts.append((".shstrtab", 3, 0, names))
    body, heads = b"", bytes(64)
    for name, kind, start, data in parts:
        heads += struct.pack("<IIQQQQIIQQ", names.index(b"\0" + name.encode() + b"\0") + 1, kind, 0, start, 64 + len(body), len(data), 0, 0, 1, 24 if kind == 4 else 0)
        body += data
    head = b"\x7fELF\x02\x01\x01".ljust(16, b"\0") + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 0, 64 + len(body), 0, 64, 0, 0, 64, 1 + len(parts), len(parts))
    return head + body + heads


def images(units: DataFrame) -> DataFrame:
    """value: an object for each row of units (functions: array of structs as `encode` takes them), of one frame."""
    return batches_of(units.select("functions"), lambda r: [[[image([r["functions"]])]]], "value binary")
