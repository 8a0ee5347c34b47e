"""Queries of library models, lifted lists and constants, and precious values, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifting, overrides, summaries
from .fixtures import fx
from .registry import query

# ---- models

ARGS = ("a", "b", "c", "d", "e")


@query(
    "+m AS (SELECT site, CASE WHEN name LIKE '%@%' THEN split_part(name, '@', 1) ELSE name END AS name, a, b, c, d, e FROM fx_model_more), "
    "tree AS (SELECT site, unnest([a, b, c, d, e]) AS x FROM m WHERE name LIKE '_ZSt18_Rb%'), "
    "out AS (SELECT 'Alloc' AS rel, site AS dst, concat('heap:', site) AS src FROM m WHERE name IN ('__mmap', 'shmat', 'fopencookie') "
    "UNION SELECT 'Assign', site, b FROM m WHERE name = 'shmat' UNION SELECT 'Assign', site, a FROM m WHERE name = 'strstr' "
    "UNION SELECT 'Store', site, a FROM m WHERE name = 'fopencookie' UNION SELECT 'Load', concat('tmp:', site), c FROM m WHERE name = 'fopencookie' "
    "UNION SELECT 'Store', site, concat('tmp:', site) FROM m WHERE name = 'fopencookie' "
    "UNION SELECT 'IndirectCall', site, d FROM m WHERE name = 'qsort_r' UNION SELECT 'Pass', site, a FROM m WHERE name = 'qsort_r' UNION SELECT 'Pass', site, e FROM m WHERE name = 'qsort_r' "
    "UNION SELECT 'IndirectCall', site, c FROM m WHERE name LIKE '_ZNSt6thread%' "
    "UNION SELECT 'Alloc', concat('tmp:', site), concat('heap:', site) FROM m WHERE name = 'posix_memalign' UNION SELECT 'Store', a, concat('tmp:', site) FROM m WHERE name = 'posix_memalign' "
    "UNION SELECT 'Assign', concat('mix:', site), x FROM tree UNION SELECT 'Store', x, concat('mix:', site) FROM tree "
    "UNION SELECT 'Alloc', concat('mix:', site), concat('heap:', site) FROM tree UNION SELECT 'Assign', site, concat('mix:', site) FROM tree) SELECT * FROM out",
    "fx_model_more",
)
def override_models(spark, sf_dir):
    return overrides.edges(fx(spark, sf_dir, "fx_model_more").select("site", "name", F.array(*ARGS).alias("args")))


@query(
    "+m AS (SELECT site, CASE WHEN name LIKE '%@%' THEN split_part(name, '@', 1) ELSE name END AS name FROM fx_model_more) "
    "SELECT site, name, CASE WHEN name IN ('__mmap', 'posix_memalign') THEN 'allocator' WHEN name = 'strtol' THEN 'empty' WHEN name LIKE '_ZSt18_Rb%' THEN 'conservative' WHEN name IN ('shmat', 'fopencookie', 'strstr') THEN 'forward' ELSE 'callback' END AS model FROM m",
    "fx_model_more",
)
def override_kinds(spark, sf_dir):
    found = overrides.resolve(fx(spark, sf_dir, "fx_model_more").select(F.col("site").alias("node"), "name"))
    return found.select(F.col("node").alias("site"), "name", "model")


@query(
    "+m AS (SELECT DISTINCT fn AS old, fn + 1000000 AS new FROM fx_line WHERE fn % 10 = 0) "
    "SELECT kind, coalesce(x.new, src) AS src, coalesce(y.new, dst) AS dst FROM fx_call LEFT JOIN m x ON src = x.old LEFT JOIN m y ON dst = y.old",
    "fx_line",
    "fx_call",
)
def override_bodies(spark, sf_dir):
    moved = fx(spark, sf_dir, "fx_line").where("fn % 10 = 0").select(F.col("fn").alias("old"), (F.col("fn") + 1000000).alias("new")).distinct()
    return overrides.substitute(fx(spark, sf_dir, "fx_call"), moved).select("kind", "src", "dst")


# ---- lifting

LISTS = "+v AS (SELECT sym AS fn, sym % 4 AS n, -1000000000 - sym * 3 AS x, -1000000001 - sym * 3 AS y, -1000000002 - sym * 3 AS z FROM fx_fn WHERE sym % 5 = 0), "


@query(
    LISTS + "out AS (SELECT 'ArgumentDefinition' AS rel, fn, z AS dst, fn AS src, CAST(n AS BIGINT) AS idx FROM v UNION ALL SELECT 'Store', fn, y, z, NULL FROM v UNION ALL SELECT 'Store', fn, x, y, NULL FROM v "
    "UNION ALL SELECT 'Load', fn, -1 - pos, x, NULL FROM fx_instr JOIN v USING (fn) WHERE opcode = 'call' UNION ALL SELECT 'Store', fn, a, -1 - pos, NULL FROM fx_instr JOIN v USING (fn) WHERE opcode = 'call') SELECT * FROM out",
    "fx_fn",
    "fx_instr",
)
def lift_variadic(spark, sf_dir):
    node = lambda i: (F.lit(-1000000000 - i) - F.col("sym") * 3).cast("bigint")
    functions = fx(spark, sf_dir, "fx_fn").where("sym % 5 = 0").select(F.col("sym").alias("fn"), (F.col("sym") % 4).alias("n_params"), node(0).alias("list"), node(1).alias("area"), node(2).alias("rest"))
    calls = fx(spark, sf_dir, "fx_instr").where("opcode = 'call'").select("fn", "pos", "opcode", "dst", F.array("a").alias("operands"), F.lit(1).cast("bigint").alias("callee"), F.lit("llvm.va_start.p0").alias("callee_name"), F.lit(1).alias("nargs"))
    return lifting.variadic(functions).unionByName(lifting.lift(calls, lists=functions))


CONSTANTS = (
    "+leaf AS (SELECT parent, CASE WHEN kind = 'global' THEN node END AS node FROM fx_constant WHERE id % 3 = 0), "
    "l1 AS (SELECT c.fn, c.id, c.parent, CASE WHEN count(l.node) > 1 THEN any_value(c.node) ELSE min(l.node) END AS node, count(l.node) AS n FROM fx_constant c JOIN leaf l ON l.parent = c.id WHERE c.id % 3 = 1 GROUP BY ALL), "
    "l2 AS (SELECT c.fn, c.id, CASE WHEN count(l.node) > 1 THEN any_value(c.node) ELSE min(l.node) END AS node, count(l.node) AS n FROM fx_constant c JOIN l1 l ON l.parent = c.id WHERE c.id % 3 = 2 GROUP BY ALL) "
)


@query(CONSTANTS + "SELECT id, CASE WHEN kind = 'global' THEN node END AS node FROM fx_constant WHERE id % 3 = 0 UNION ALL SELECT id, node FROM l1 UNION ALL SELECT id, node FROM l2", "fx_constant")
def lift_constants(spark, sf_dir):
    return lifting.constants(fx(spark, sf_dir, "fx_constant"))[0]


@query(
    CONSTANTS + "SELECT DISTINCT 'Assign' AS rel, fn, l1.node AS dst, leaf.node AS src, CAST(NULL AS BIGINT) AS idx FROM l1 JOIN leaf ON leaf.parent = l1.id WHERE n > 1 AND leaf.node IS NOT NULL "
    "UNION SELECT 'Assign', l2.fn, l2.node, l1.node, NULL FROM l2 JOIN l1 ON l1.parent = l2.id WHERE l2.n > 1 AND l1.node IS NOT NULL",
    "fx_constant",
)
def lift_constant_edges(spark, sf_dir):
    return lifting.constants(fx(spark, sf_dir, "fx_constant"))[1]


@query(
    "+c AS (SELECT fn, ok * 10 + ln AS dst, fn % 3 > 0 AS wide, 1 + ln % 2 AS n, unnest([tgt, sk, ok, CASE WHEN sk % 2 = 0 THEN tgt + sk END][1:ln % 5]) AS src, unnest(range(0, CAST(ln % 5 AS BIGINT))) AS i FROM fx_line WHERE ln % 5 < 5), "
    "k AS (SELECT fn, ok * 10 + ln AS dst, tgt AS src, CAST(1 + ln % 2 + CASE WHEN fn % 3 > 0 AND ln % 5 > 0 THEN 1 ELSE 0 END AS BIGINT) AS idx FROM fx_line) "
    "SELECT 'ArgumentSupply' AS rel, fn, dst, src, CASE WHEN wide THEN least(i, n) ELSE i END AS idx FROM c WHERE src IS NOT NULL UNION ALL SELECT 'Call', fn, dst, src, idx FROM k",
    "fx_line",
)
def lift_variadic_calls(spark, sf_dir):
    line = fx(spark, sf_dir, "fx_line")
    given = F.slice(F.array("tgt", "sk", "ok", F.when(F.col("sk") % 2 == 0, F.col("tgt") + F.col("sk"))), F.lit(1), (F.col("ln") % 5).cast("int"))
    calls = line.select("fn", (F.col("ok") * 10 + F.col("ln")).alias("pos"), F.lit("call").alias("opcode"), (F.col("ok") * 10 + F.col("ln")).alias("dst"), given.alias("operands"), F.col("tgt").alias("callee"), (F.col("fn") % 3 > 0).alias("is_variadic"), (1 + F.col("ln") % 2).alias("n_params"))
    return lifting.lift(calls)


# ---- precious values

SITE = 1 << 40
PRECIOUS = (
    f"+sup AS (SELECT {SITE} + fn AS site, value FROM fx_arg), al AS (SELECT DISTINCT dst AS node FROM fx_load), "
    f"base AS (SELECT sym AS v FROM fx_fn WHERE sym % 50 = 0 UNION SELECT dst FROM fx_assign UNION SELECT {SITE} + caller FROM fx_call_direct UNION SELECT site FROM sup UNION SELECT value FROM sup WHERE value IN (SELECT node FROM al)), "
    "p(v) AS (SELECT v FROM base UNION SELECT src FROM p JOIN fx_store ON dst = v) "
)
USES = ("fx_arg", "fx_load", "fx_fn", "fx_assign", "fx_call_direct", "fx_store")


def kept(spark, sf_dir):
    of = lambda n: fx(spark, sf_dir, n)
    edge = lambda rows, rel, dst, src: rows.select(F.lit(rel).alias("rel"), dst.alias("dst"), src.alias("src"))
    site = lambda c: F.lit(SITE) + F.col(c)
    edges = (
        edge(of("fx_assign"), "ArgumentDefinition", F.col("dst"), F.col("src"))
        .unionByName(edge(of("fx_call_direct"), "Call", site("caller"), F.col("callee")))
        .unionByName(edge(of("fx_arg"), "ArgumentSupply", site("fn"), F.col("value")))
    )
    names = of("fx_store").select(F.col("dst").alias("core"), F.col("src").alias("value"))
    allocas = of("fx_load").select(F.col("dst").alias("node")).distinct()
    return summaries.precious(edges, of("fx_fn").where("sym % 50 = 0").select(F.col("sym").alias("node")), allocas, names), names, allocas


@query(PRECIOUS + "SELECT v FROM p", *USES, recursive=True)
def precious_values(spark, sf_dir):
    return kept(spark, sf_dir)[0]


@query(
    PRECIOUS + "SELECT 'Starred' AS rel, dst AS a, src AS b FROM fx_assign WHERE dst IN (SELECT v FROM p) UNION SELECT 'ValueName', dst, src FROM fx_store WHERE dst IN (SELECT v FROM p) UNION SELECT 'IsAlloca', node, NULL FROM al WHERE node IN (SELECT v FROM p)",
    *USES,
    recursive=True,
)
def precious_facts(spark, sf_dir):
    found, names, allocas = kept(spark, sf_dir)
    stars = fx(spark, sf_dir, "fx_assign").select(F.col("dst").alias("starred"), F.col("src").alias("node"))
    return summaries.precious_facts(found, stars, names, allocas)
