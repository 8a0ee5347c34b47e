"""Fixed-size binary records by a declared layout: C's sizes and offsets, a Spark schema, and a decoder of whole columns.

A layout is built of Int, Array, Enum, Flags, Pointer, Atomic and Struct. It is compiled once to a numpy type with
explicit offsets; a file's records are then one array, and each field becomes an Arrow column without a step per record.
Unsigned 64-bit numbers and pointers are decimals, other unsigned ones the next larger number; enums are names, stored
from 1 on, with 0 for none; flags are bit masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BIG = T.DecimalType(20, 0)


@dataclass(frozen=True)
class Int:
    bits: int
    signed: bool = False

    size = property(lambda self: self.bits // 8)
    align = property(lambda self: self.bits // 8)

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"<{'i' if self.signed else 'u'}{self.size}")

    @property
    def spark(self) -> T.DataType:
        return BIG if self.bits == 64 and not self.signed else {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType()}[self.bits if self.signed else 2 * self.bits]

    def column(self, x: np.ndarray) -> pa.Array:
        if self.bits < 64 or self.signed:
            return pa.array(np.ascontiguousarray(x)).cast(to_arrow_type(self.spark))
        wide = np.zeros((len(x), 2), np.uint64)
        wide[:, 0] = x
        return pa.Array.from_buffers(pa.decimal128(20, 0), len(x), [None, pa.py_buffer(wide.tobytes())])

    def pack(self, value: int) -> bytes:
        return int(value).to_bytes(self.size, "little", signed=self.signed)


@dataclass(frozen=True)
class Pointer(Int):
    bits: int = 64


@dataclass(frozen=True)
class Atomic:
    """As what it is of."""

    of: object

    size = property(lambda self: self.of.size)
    align = property(lambda self: self.of.align)
    dtype = property(lambda self: self.of.dtype)
    spark = property(lambda self: self.of.spark)

    def column(self, x: np.ndarray) -> pa.Array:
        return self.of.column(x)

    def pack(self, value) -> bytes:
        return self.of.pack(value)


def smallest(most: int) -> Int:
    """The smallest unsigned number that holds `most`."""
    return next(Int(b) for b in (8, 16, 32, 64) if most < 1 << b)


@dataclass(frozen=True)
class Enum:
    names: tuple[str, ...]

    stored = property(lambda self: smallest(len(self.names) + 1))
    size = property(lambda self: self.stored.size)
    align = property(lambda self: self.stored.align)
    dtype = property(lambda self: self.stored.dtype)
    spark = T.StringType()

    def column(self, x: np.ndarray) -> pa.Array:
        if len(x) and x.max() > len(self.names):
            raise ValueError(f"{x.max()} is none of {', '.join(self.names)}")
        return pa.array(np.array([None, *self.names], object)[x], pa.string())

    def pack(self, value: str | None) -> bytes:
        return self.stored.pack(0 if value is None else 1 + self.names.index(value))


@dataclass(frozen=True)
class Flags:
    names: tuple[str, ...]

    stored = property(lambda self: smallest(1 << len(self.names)))
    size = property(lambda self: self.stored.size)
    align = property(lambda self: self.stored.align)
    dtype = property(lambda self: self.stored.dtype)
    spark = property(lambda self: self.stored.spark)

    def column(self, x: np.ndarray) -> pa.Array:
        return self.stored.column(x)

    def pack(self, value: set[str]) -> bytes:
        return self.stored.pack(sum(1 << self.names.index(n) for n in value))

    def has(self, column: str, name: str):
        """Whether a column of masks has the flag."""
        return F.col(column).cast("bigint").bitwiseAND(F.lit(1 << self.names.index(name))) != 0


@dataclass(frozen=True)
class Array:
    of: object
    count: int

    size = property(lambda self: self.of.size * self.count)
    align = property(lambda self: self.of.align)
    dtype = property(lambda self: np.dtype((self.of.dtype, (self.count,))))
    spark = property(lambda self: T.ArrayType(self.of.spark))

    def column(self, x: np.ndarray) -> pa.Array:
        flat = self.of.column(np.ascontiguousarray(x).reshape(len(x) * self.count, *x.shape[2:]))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * self.count), flat)

    def pack(self, value) -> bytes:
        if len(value) != self.count:
            raise ValueError(f"{len(value)} values for {self.count} places")
        return b"".join(map(self.of.pack, value))


@dataclass(frozen=True)
class Struct:
    fields: tuple[tuple[str, object], ...]

    @property
    def offsets(self) -> list[int]:
        out, at = [], 0
        for _, kind in self.fields:
            at = -(-at // kind.align) * kind.align
            out.append(at)
            at += kind.size
        return out

    @property
    def align(self) -> int:
        return max(kind.align for _, kind in self.fields)

    @property
    def size(self) -> int:
        end = self.offsets[-1] + self.fields[-1][1].size
        return -(-end // self.align) * self.align

    @property
    def dtype(self) -> np.dtype:
        return np.dtype({"names": [n for n, _ in self.fields], "formats": [k.dtype for _, k in self.fields], "offsets": self.offsets, "itemsize": self.size})

    @property
    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(n, k.spark) for n, k in self.fields])

    def column(self, x: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([k.column(x[n]) for n, k in self.fields], [n for n, _ in self.fields])

    def pack(self, value: dict) -> bytes:
        out = bytearray(self.size)
        for (n, k), at in zip(self.fields, self.offsets, strict=True):
            out[at : at + k.size] = k.pack(value[n])
        return bytes(out)


# fixed values: the records of traces
SITE = Struct((("function", Pointer()), ("local", Int(32))))
EDGE = Struct((("site", Int(64)), ("value", Int(64))))
PAGE_POINTERS = 16384 // 8 - 2
PAGE = Struct((("next", Atomic(Pointer())), ("count", Atomic(Int(64))), ("pointers", Array(Atomic(Pointer()), PAGE_POINTERS))))


def records(files: DataFrame, layout: Struct) -> DataFrame:
    """path, number (of the record in its file) and the layout's fields, of files (path, content). A short tail is ignored."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("number", T.LongType()), *layout.spark.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0), b.column(1), strict=True):
                raw = data.as_buffer()
                every = np.frombuffer(raw, layout.dtype, raw.size // layout.size)
                step = max(1, (8 << 20) // layout.size)
                for at in range(0, len(every), step):
                    x = every[at : at + step]
                    columns = [pa.array([path.as_py()] * len(x), pa.string()), pa.array(np.arange(at, at + len(x))), *(k.column(x[n]) for n, k in layout.fields)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return files.select("path", "content").mapInArrow(run, schema)


def packed(rows: DataFrame, layout: Struct) -> DataFrame:
    """value: a record's bytes for each of rows (columns as the layout's fields)."""
    names = [n for n, _ in layout.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([layout.pack(r) for r in b.to_pylist()], pa.binary())], names=["value"])

    return rows.select(*names).mapInArrow(run, "value binary")
