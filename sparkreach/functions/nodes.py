"""Nodes: a symbol with an optional local, packed in 64 bits, as text, and as 32-bit stream words. Built-in functions only.

The packed word is (symbol + 1) in the upper 48 bits and local + 1 (0: the symbol itself) in the lower 16; 0 is no
node. Spark has no unsigned type: order by (symbol, local), not by the word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_SYMBOL, MOST_LOCAL = (1 << 48) - 2, (1 << 16) - 2


def pack(symbol: Column, local: Column | None = None) -> Column:
    low = F.lit(0).cast("bigint") if local is None else F.coalesce(local.cast("bigint") + 1, F.lit(0).cast("bigint"))
    word = F.shiftleft(symbol.cast("bigint") + 1, 16).bitwiseOR(low)
    within = symbol.between(0, MOST_SYMBOL) & (low <= MOST_LOCAL + 1)
    return F.when(symbol.isNull(), None).when(within, word).otherwise(F.raise_error(F.lit("symbol or local out of range")).cast("bigint"))


def symbol_of(word: Column) -> Column:
    return F.when(word != 0, F.shiftrightunsigned(word, 16) - 1)


def local_of(word: Column) -> Column:
    low = word.bitwiseAND(F.lit(0xFFFF))
    return F.when(low > 0, (low - 1).cast("int"))


def is_local(word: Column) -> Column:
    return word.bitwiseAND(F.lit(0xFFFF)) > 0


def text(symbol: Column, local: Column | None = None) -> Column:
    """0x and 16 hex digits, then :0x and 4 hex digits for a local."""
    head = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(symbol)), 16, "0"))
    if local is None:
        return head
    return F.when(local.isNull(), head).otherwise(F.concat(head, F.lit(":0x"), F.lpad(F.lower(F.hex(local)), 4, "0")))


def from_text(x: Column) -> Column:
    """struct of symbol and local; an error unless there are one or two parts."""
    parts = F.split(x, ":")
    number = lambda c: F.conv(F.regexp_replace(c, "^0x", ""), 16, 10).cast("bigint")
    found = F.struct(number(parts[0]).alias("symbol"), F.when(F.size(parts) == 2, number(F.get(parts, F.lit(1)))).cast("int").alias("local"))
    return F.when(x.isNull(), None).when(F.size(parts).between(1, 2), found).otherwise(F.raise_error(F.concat(F.lit("not a node: "), x)).cast("struct<symbol:bigint,local:int>"))


def symbol_text(x: Column) -> Column:
    """The enclosing symbol of a node's text."""
    return F.substring_index(x, ":", 1)


def number_or_text(x: Column) -> Column:
    """A hex number as decimal text, anything else as it is."""
    return F.when(x.rlike("^0x[0-9a-fA-F]+$"), F.conv(F.substring(x, 3, 32), 16, 10)).otherwise(x)


def encode_index(symbol: Column, local: Column) -> Column:
    """Stream word: index * 2 for locals, index * 2 + 1 for symbols."""
    return F.coalesce(local.cast("bigint") * 2, symbol.cast("bigint") * 2 + 1)


def zigzag(x: Column) -> Column:
    return (x.cast("bigint") * 2).bitwiseXOR(F.shiftright(x.cast("bigint"), 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x.cast("bigint"), 1).bitwiseXOR(-x.cast("bigint").bitwiseAND(F.lit(1)))


def starred(x: Column, n: Column, most: int = 3) -> Column:
    """x behind n stars; the last level is marked with a dollar sign as well."""
    return F.when(n < most, F.concat(F.repeat(F.lit("*"), n), x)).otherwise(F.concat(F.lit("$" + "*" * most), x))


def normal_symbol(x: Column) -> Column:
    """A plain function name: no arrow, no star, no leading dot."""
    return ~x.contains(" -> ") & ~x.contains("*") & ~x.startswith(".")


def without_version(x: Column) -> Column:
    return F.substring_index(x, "@", 1)


def debug_name(symbol_name: Column, local: Column, local_name: Column) -> Column:
    head = F.coalesce(symbol_name, F.lit("<UnknownSymbol>"))
    return F.when(local.isNull(), head).otherwise(F.concat(head, F.lit(" -> "), F.coalesce(local_name, F.lit("<DebugDataMissing>"))))


def clear_epoch(word: Column) -> Column:
    """A trace word without its lowest bit, which is bookkeeping."""
    return F.shiftleft(F.shiftright(word, 1), 1)


def epoch(word: Column) -> Column:
    return word.bitwiseAND(F.lit(1))


def location(x: Column) -> Column:
    """file, line, column and name of `file:line:col|name`; an inlining suffix is cut, line 0 gives null."""
    plain = F.substring_index(x, "@[", 1)
    at = lambda i: F.regexp_extract(plain, r"^(.*):([0-9]+):([0-9]+)\|(.*)$", i)
    return F.when(plain.rlike(r"^.*:[1-9][0-9]*:[0-9]+\|"), F.struct(at(1).alias("file"), at(2).cast("bigint").alias("line"), at(3).cast("bigint").alias("col"), at(4).alias("name")))
