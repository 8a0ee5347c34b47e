"""Names and texts of reports: short names of mangled functions, identifiers, paths, fingerprints, classification texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: Itanium ABI abbreviations
STANDARD = {"t": "std", "a": "std::allocator", "b": "std::basic_string", "s": "std::string", "i": "std::istream", "o": "std::ostream", "d": "std::iostream"}
OPERATORS = {"nw": "operator new", "na": "operator new[]", "dl": "operator delete", "da": "operator delete[]", "pl": "operator+", "mi": "operator-", "ml": "operator*", "dv": "operator/", "rm": "operator%", "eq": "operator==", "ne": "operator!=", "lt": "operator<", "gt": "operator>", "le": "operator<=", "ge": "operator>=", "ls": "operator<<", "rs": "operator>>", "aS": "operator=", "pL": "operator+=", "mI": "operator-=", "cl": "operator()", "ix": "operator[]", "pt": "operator->", "nt": "operator!", "aa": "operator&&", "oo": "operator||", "pp": "operator++", "mm": "operator--"}


def short_name(mangled: str | None) -> str | None:
    """The last component of a function's name, without template arguments; null where the mangling is not understood. Other names pass through."""
    if mangled is None or not mangled.startswith("_Z"):
        return mangled
    s, i, found = mangled, 2, []

    def skip_template(i: int) -> int:
        """Past I...E, by counting what opens and closes; source names are jumped over."""
        depth = 0
        while i < len(s):
            if m := re.compile(r"[1-9][0-9]*").match(s, i):
                i = m.end() + int(m.group())
                continue
            c = s[i]
            depth += c in "INXJL"
            depth -= c == "E"
            i += 1
            if depth == 0:
                return i
        raise ValueError

    try:
        nested = s[i] == "N"
        i += nested
        if nested:
            while s[i] in "rVKRO":
                i += 1
        while i < len(s):
            if m := re.compile(r"[1-9][0-9]*").match(s, i):
                n = int(m.group())
                if m.end() + n > len(s):
                    return None
                found.append(s[m.end() : m.end() + n])
                i = m.end() + n
            elif s[i] == "S" and s[i + 1] in STANDARD:
                found += STANDARD[s[i + 1]].split("::")
                i += 2
            elif s[i] == "S" and (m := re.compile(r"S[0-9A-Z]*_").match(s, i)):
                found.append("")
                i = m.end()
            elif s[i] in "CD" and s[i + 1 : i + 2].isdigit() and found:
                found.append(("~" if s[i] == "D" else "") + found[-1])
                i += 2
            elif s[i] == "L":
                i += 1
            elif s[i] == "B" and (m := re.compile(r"B([0-9]+)").match(s, i)):
                i = m.end() + int(m.group(1))
            elif s[i] == "I":
                i = skip_template(i)
            elif s[i : i + 2] in OPERATORS:
                found.append(OPERATORS[s[i : i + 2]])
                i += 2
            elif nested and s[i] == "E":
                break
            else:
                if nested:
                    return None
                break
            if not nested and not (s[i : i + 1] in ("I", "B") or len(found) == 1 and found[0] == "std" and s[2:4] == "St"):
                break
        return found[-1] or None if found else None
    except (IndexError, ValueError):
        return None


@F.pandas_udf(T.StringType())
def short_names(x: pd.Series) -> pd.Series:
    return x.map(short_name, na_action="ignore")


def function_name(x: Column) -> Column:
    """The short name. All names go through Python, also those that are not mangled; `with_function_name` sends distinct mangled ones alone."""
    return F.when(x.startswith("_Z"), short_names(x)).otherwise(x)


def with_function_name(rows: DataFrame, column: str, out: str) -> DataFrame:
    """rows with the short name of a column; each distinct mangled name leaves the JVM once."""
    mangled = rows.where(F.col(column).startswith("_Z")).select(F.col(column).alias("_mangled")).distinct()
    short = mangled.select("_mangled", short_names("_mangled").alias("_short"))
    held = rows.join(short, rows[column] == short["_mangled"], "left")
    return held.withColumn(out, F.when(F.col(column).startswith("_Z"), F.col("_short")).otherwise(F.col(column))).drop("_mangled", "_short")


def identifier(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\W", "_"), "_+", "_")


# fixed values: the texts of verdicts that reports change
PRESENT = "Target function (.*?) is present"
NO_SYMBOLS = "No additional symbols were required to be reachable."


def address_name(address: Column, prefix: str = "node_", suffix: str = "x") -> Column:
    """The identifier of a node without a name of its own."""
    return F.concat(F.lit(prefix), F.lower(F.hex(address)), F.lit(suffix))


def name_address(name: Column, prefix: str = "node_", suffix: str = "x") -> Column:
    """The address that address_name gave the name for, else null."""
    digits = F.regexp_extract(name, f"^{re.escape(prefix)}([0-9a-fA-F]{{1,16}}){re.escape(suffix)}$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).try_cast("bigint"))


def chosen(values: Column) -> Column:
    """A C expression that may be any of the values (array of texts): NULL of none, the value of one."""
    start = F.coalesce(F.get(values, F.lit(0)), F.lit("NULL"))
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, start, lambda out, x: F.concat(F.lit("NONDET_SELECT("), out, F.lit(", "), x, F.lit(")")))


def local_names(locals_: DataFrame) -> DataFrame:
    """fn, local, name: identifiers of a function's locals, no two alike. locals_: fn, local, debug (the part behind the last bar counts).

    Locals are taken in order; one whose name is taken gets _1 behind it until it is not. Locals with several debug names
    get none. A function has fewer than 65,536 locals, so it is one group; the n-th of a name is 2 n characters longer.
    """
    single = locals_.groupBy("fn", "local").agg(F.min("debug").alias("debug"), F.count_distinct("debug").alias("n")).where("n = 1")
    wanted = single.select("fn", "local", F.concat(F.lit("LOCAL"), identifier(F.substring_index("debug", "|", -1))).alias("name"))

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        taken, next_try, out = set(), {}, []
        rows = rows.sort_values("local")
        for wish in rows["name"]:
            name = next_try.get(wish, wish)
            while name in taken:
                name += "_1"
            taken.add(name)
            next_try[wish] = name + "_1"
            out.append(name)
        return rows.assign(name=out)

    return wanted.groupBy("fn").applyInPandas(of, wanted.schema)


def target_function(justification: Column) -> Column:
    """The function that a verdict's text names."""
    found = F.regexp_extract(justification, PRESENT, 1)
    return F.when(justification.rlike(PRESENT), found).otherwise("Unknown Target")


def report_text(justification: Column) -> Column:
    """A verdict's text as reports show it."""
    changed = F.replace(F.replace(justification, F.lit("Target function"), F.lit("Vulnerable function")), F.lit(NO_SYMBOLS), F.lit(""))
    return F.regexp_replace(changed, r"^\s+|\s+$", "")


def map_prefix(x: Column, prefixes: list[tuple[str, str]]) -> Column:
    """The first matching prefix is replaced, once."""
    out = x
    for old, new in reversed(prefixes):
        out = F.when(x.startswith(old), F.concat(F.lit(new), F.substring(x, len(old) + 1, 1 << 20))).otherwise(out)
    return out


def relative(x: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(x.startswith(root), F.substring(x, len(root) + 1, 1 << 20)).otherwise(x)


def fingerprint(kind: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("-", F.lit(kind), *(p.cast("string") for p in parts)))


def content_name(x: Column) -> Column:
    """32 characters of URL-safe base 64 of the SHA-256."""
    return F.substring(F.translate(F.base64(F.unhex(F.sha2(x, 256))), "+/", "-_"), 1, 32)


def percent_change(new: Column, old: Column) -> Column:
    return (new - old) / old * 100


def arrow(kind: Column) -> Column:
    return F.when(kind == "Direct", " ---> ").when(kind == "Indirect", " -I-> ").otherwise(" -?-> ")


def override_arity(signature: Column) -> Column:
    """struct of name and number of arguments of a C signature."""
    args = F.trim(F.regexp_extract(signature, r"(\w+)\s*\(([^)]*)\)", 2))
    return F.struct(F.regexp_extract(signature, r"(\w+)\s*\(", 1).alias("name"), F.when((args == "") | (args == "void"), 0).otherwise(F.size(F.split(args, ","))).alias("nargs"))


def include_port(file: Column) -> Column:
    """stem, stem before the first underscore of the whole name, and folder of a header's path: the keys of a port, in order."""
    name = F.substring_index(file, "/", -1)
    return F.array(F.regexp_replace(name, r"\.[^.]*$", ""), F.substring_index(name, "_", 1), F.element_at(F.split(file, "/"), F.greatest(F.size(F.split(file, "/")) - 1, F.lit(1))))
