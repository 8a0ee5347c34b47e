"""Lifting: instructions to edges, by rules per opcode.

instr: fn, pos, opcode, dst (node of the result, or null), operands (array of nodes; null for data), callee, nargs.
Output: rel, fn, dst, src, idx. Edges with a missing end are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .fixpoint import union

# fixed values: opcodes by the edges that they give
FIRST_OPERAND = ("getelementptr", "ptrtoint", "inttoptr", "bitcast", "addrspacecast", "trunc", "zext", "sext", "freeze", "fneg", "extractvalue", "extractelement")
EVERY_OPERAND = ("phi", "select", "insertvalue", "insertelement", "shufflevector", "binary")
READ_WRITE = ("cmpxchg", "atomicrmw")
COPIES = ("llvm.memcpy", "llvm.memmove", "llvm.va_copy")
LISTS = "llvm.va_start"
SKIPPED_FUNCTIONS = ("__liballocs",)


def _edge(rows: DataFrame, rel: str, dst: str, src: str, idx: str = "NULL") -> DataFrame:
    out = rows.select(F.lit(rel).alias("rel"), "fn", F.expr(dst).alias("dst"), F.expr(src).alias("src"), F.expr(f"cast({idx} as bigint)").alias("idx"))
    return out.where("dst IS NOT NULL AND src IS NOT NULL")


def defined(functions: DataFrame) -> DataFrame:
    """Functions whose bodies are lifted: no intrinsics, declarations or runtime functions. functions: fn, fname, is_declaration."""
    skipped = F.col("fname").startswith("llvm.")
    for s in SKIPPED_FUNCTIONS:
        skipped = skipped | F.col("fname").startswith(s)
    return functions.where(~skipped & ~F.col("is_declaration"))


def lift(instr: DataFrame, aliases: DataFrame | None = None, lists: DataFrame | None = None) -> DataFrame:
    """All edges of the instructions. aliases: alias, target, resolved in callees. lists: fn, list, the model argument list that va_start copies.

    Where instr has is_variadic and n_params (of the called type), all arguments of a variadic call beyond its
    parameters go to one place, the next one, and so many are told; a call of none is not taken as variadic.
    """
    if aliases is not None:
        instr = instr.join(aliases, instr["callee"] == aliases["alias"], "left").withColumn("callee", F.coalesce("target", "callee")).drop("alias", "target")
    op = lambda *names: instr.where(F.col("opcode").isin(*names))
    each = op(*EVERY_OPERAND).select("fn", "dst", F.explode("operands").alias("o"))
    calls = op("call", "invoke").where("callee IS NOT NULL")
    plain = calls.where("coalesce(callee_name, '') <> 'dlsym' AND NOT coalesce(callee_name, '') LIKE 'llvm.%'") if "callee_name" in instr.columns else calls
    nargs, at = "nargs", "i"
    if "is_variadic" in instr.columns:
        wide = "coalesce(is_variadic, false) AND size(operands) > 0"
        nargs, at = f"n_params + if({wide}, 1, 0)", f"if({wide}, least(i, n_params), i)"
    supplied = plain.select("*", F.posexplode("operands").alias("i", "o"))
    out = [
        _edge(op("store"), "Store", "operands[1]", "operands[0]"),
        _edge(op("load"), "Load", "dst", "operands[0]"),
        _edge(op(*READ_WRITE), "Load", "dst", "operands[0]"),
        _edge(op(*READ_WRITE), "Store", "operands[0]", "operands[size(operands) - 1]"),
        _edge(op(*FIRST_OPERAND), "Assign", "dst", "operands[0]"),
        _edge(each, "Assign", "dst", "o"),
        _edge(op("ret").where("size(operands) > 0"), "Return", "fn", "operands[0]"),
        _edge(plain, "Call", "dst", "callee", nargs),
        _edge(supplied, "ArgumentSupply", "dst", "o", at),
    ]
    if "callee_name" in instr.columns:
        out.append(_edge(calls.where("callee_name = 'dlsym'"), "Dlsym", "dst", "dst"))
        some = calls.where(F.regexp_extract("callee_name", r"^(llvm\.[a-z_]+)", 1).isin(*COPIES))
        tmp = "-1 - pos"  # a place of the instruction's own
        out += [_edge(some, "Load", tmp, "operands[1]"), _edge(some, "Store", "operands[0]", tmp)]
        if lists is not None:
            opened = calls.where(F.col("callee_name").startswith(LISTS)).join(lists.select("fn", "list"), "fn")
            out += [_edge(opened, "Load", tmp, "list"), _edge(opened, "Store", "operands[0]", tmp)]
    return union(out)


def parameters(params: DataFrame) -> DataFrame:
    """ArgumentDefinition edges. params: fn, arg_no, node."""
    return params.select(F.lit("ArgumentDefinition").alias("rel"), "fn", F.col("node").alias("dst"), F.col("fn").alias("src"), F.col("arg_no").cast("bigint").alias("idx"))


def variadic(functions: DataFrame) -> DataFrame:
    """Edges of the model argument list of variadic functions: all further arguments flow into one value, stored in an area that the list points to.

    functions: fn, n_params, list, area, rest (three unused nodes of the function).
    """
    out = [
        functions.select(F.lit("ArgumentDefinition").alias("rel"), "fn", F.col("rest").alias("dst"), F.col("fn").alias("src"), F.col("n_params").cast("bigint").alias("idx")),
        _edge(functions, "Store", "area", "rest"),
        _edge(functions, "Store", "list", "area"),
    ]
    return union(out)


def constants(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, node) of constants and the Assign edges between them. parts: fn, id, parent (null at the top), kind, node.

    A global is its symbol's node; data are none. Of an aggregate or expression without nodes among its parts there is
    none, with one it is that, and of more its own node (an unused one) gets them all. Rounds: the depth of nesting. A
    round moves what was done in the last one and what still waits, which holds what it knows of its parts.
    """
    spark = parts.sparkSession
    kids = parts.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_kids"))
    tree = parts.select("fn", "id", "parent", "node", (F.col("kind") == "global").alias("is_global")).join(kids, "id", "left")
    tree = tree.select("fn", "id", "parent", F.when(F.col("n_kids").isNotNull() | F.col("is_global"), F.col("node")).alias("node"), "n_kids")
    tree = written(tree.withColumn("waits", F.col("n_kids").isNotNull()), "parts", "waits")
    new = tree.where("NOT waits").select("id", "parent", "node")
    waiting = tree.where("waits").select("fn", "id", "parent", "node", "n_kids", *(F.lit(0).cast("bigint").alias(c) for c in ("n_done", "n_nodes")), F.lit(None).cast("bigint").alias("one"))
    found, inner = [new], []
    while not (new.isEmpty() or waiting.isEmpty()):
        more = new.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("d"), F.count("node").alias("k"), F.min("node").alias("m"))
        sums = {"n_done": F.expr("n_done + coalesce(d, 0)"), "n_nodes": F.expr("n_nodes + coalesce(k, 0)"), "one": F.expr("least(one, m)")}  # least passes over nulls
        state = waiting.join(more, "id", "left").withColumns(sums).select(*waiting.columns)
        state = written(state.withColumn("done", F.expr("n_done = n_kids")), "constants", "done")
        done = state.where("done")
        new = done.select("id", "parent", F.when(F.col("n_nodes") > 1, F.col("node")).otherwise(F.col("one")).alias("node"))
        found.append(new)
        inner.append(done.where("n_nodes > 1").select("fn", "id", "node"))
        waiting = state.where("NOT done").select(*waiting.columns)
    every = union(found)
    if not inner:
        return every.select("id", "node"), _edge(spark.createDataFrame([], tree.schema), "Assign", "node", "node")
    of = every.where("parent IS NOT NULL AND node IS NOT NULL").select(F.col("parent").alias("id"), F.col("node").alias("src"))
    return every.select("id", "node"), _edge(union(inner).withColumnRenamed("node", "dst").join(of, "id"), "Assign", "dst", "src").distinct()


def initialisers(globals_: DataFrame) -> DataFrame:
    """Store edges of global initialisers, in one synthetic function a group. globals_: comdat, global, value."""
    fn = F.concat(F.lit("globals_"), F.coalesce("comdat", F.lit("")))
    return globals_.where("value IS NOT NULL").select(F.lit("Store").alias("rel"), fn.alias("fn"), F.col("global").alias("dst"), F.col("value").alias("src"), F.lit(None).cast("bigint").alias("idx"))


def traced(instr: DataFrame, mode: str) -> DataFrame:
    """fn, pos, what of the places that a trace mode records: none, indirect callees, or those, loads and arguments."""
    if mode == "off":
        return instr.where("false").select("fn", "pos", F.lit("").alias("what"))
    indirect = instr.where("opcode IN ('call', 'invoke') AND callee_is_local").select("fn", "pos", F.lit("callee").alias("what"))
    if mode == "indirect_callees":
        return indirect
    return indirect.unionByName(instr.where("opcode = 'load'").select("fn", "pos", F.lit("load").alias("what"))).unionByName(instr.where("opcode IN ('call', 'invoke')").select("fn", "pos", F.lit("argument").alias("what")))
