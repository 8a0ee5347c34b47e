"""Semantic versions and version ranges, in built-in functions.

A version is a struct that Spark orders as SemVer does: major, minor, patch, then whether it is a release, then the
prerelease's identifiers, numeric ones below textual ones; build metadata are ignored. One leading v is dropped, text
from # on is cut, minor and patch may be missing; anything else gives null.

A range is alternatives, separated by |: a lower bound opens a group, an upper bound closes it, an exact version stands
alone. A version satisfies it if it meets all constraints of any group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(?:0|[1-9][0-9]*)"
PATTERN = rf"^v?({NUMBER})(?:\.({NUMBER}))?(?:\.({NUMBER}))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def parse(x: Column) -> Column:
    plain = F.trim(F.substring_index(x, "#", 1))
    part = lambda i: F.regexp_extract(plain, PATTERN, i)
    number = lambda i: F.coalesce(F.nullif(part(i), F.lit("")).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    pre = F.filter(F.split(part(4), r"\."), lambda p: p != "")
    identifiers = F.transform(pre, lambda p: F.struct((~p.rlike("^[0-9]+$")).alias("textual"), F.when(p.rlike("^[0-9]+$"), p.cast("decimal(38,0)")).alias("number"), p.alias("text")))
    return F.when(plain.rlike(PATTERN), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (F.size(pre) == 0).alias("release"), identifiers.alias("pre")))


def compare(version: Column, op: Column, bound: Column) -> Column:
    return F.when(op == ">=", version >= bound).when(op == "<=", version <= bound).when(op == ">", version > bound).when(op == "<", version < bound).otherwise(version == bound)


def constraints(x: Column) -> Column:
    """array of op, version text; an absent operator means equality."""
    return F.transform(
        F.filter(F.transform(F.split(x, r"\|"), lambda p: F.trim(p)), lambda p: p != ""),
        lambda p: F.struct(F.when(p.rlike("^(>=|<=|=|<|>)"), F.regexp_extract(p, "^(>=|<=|=|<|>)", 1)).otherwise("=").alias("op"), F.trim(F.regexp_replace(p, "^(>=|<=|=|<|>)", "")).alias("text")),
    )


def groups(x: Column) -> Column:
    """array of groups, each an array of constraints."""
    one = "array<struct<op:string,text:string>>"
    start = F.struct(F.array().cast(f"array<{one}>").alias("done"), F.array().cast(one).alias("open"))

    def add(a: Column, c: Column) -> Column:
        closed = F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
        none = F.array().cast(one)
        return (
            F.when(c["op"] == "=", F.struct(F.concat(closed, F.array(F.array(c))).alias("done"), none.alias("open")))
            .when(c["op"].isin(">", ">="), F.struct(closed.alias("done"), F.array(c).alias("open")))
            .otherwise(F.struct(F.concat(a["done"], F.array(F.concat(a["open"], F.array(c)))).alias("done"), none.alias("open")))
        )

    return F.aggregate(constraints(x), start, add, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))


def satisfies(version: Column, ranges: Column) -> Column:
    """Whether the version's text lies in the range; null for a bad version, an error for a bad bound."""
    bound = lambda c: F.coalesce(parse(c["text"]), F.raise_error(F.concat(F.lit("bad version in a range: "), c["text"])).cast("struct<major:decimal(38,0),minor:decimal(38,0),patch:decimal(38,0),release:boolean,pre:array<struct<textual:boolean,number:decimal(38,0),text:string>>>"))
    parsed = F.transform(F.array(parse(version)), lambda v: F.when(v.isNotNull(), F.exists(groups(ranges), lambda g: F.forall(g, lambda c: compare(v, c["op"], bound(c))))))
    return F.element_at(parsed, 1)
