"""Facts derived from the test tables: each a view in SQL that Spark and DuckDB both take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "fx_fn": "SELECT p_partkey AS sym, CASE WHEN p_partkey = 0 THEN 'main' WHEN p_partkey % 97 = 0 THEN concat('globals_', CAST(p_partkey AS STRING)) ELSE concat('f_', CAST(p_partkey AS STRING)) END AS fname, p_brand AS component, concat(CAST(p_size % 3 AS STRING), '.', CAST(p_size % 10 AS STRING), '.', CAST(p_partkey % 7 AS STRING)) AS version FROM part",
    "fx_line": "SELECT DISTINCT l_partkey AS fn, l_orderkey AS ok, l_linenumber AS ln, l_quantity AS q, (l_orderkey * 31 + l_suppkey * 17 + l_linenumber * 7) % (SELECT max(p_partkey) + 1 FROM part) AS tgt, l_suppkey AS sk, l_tax AS tax, l_returnflag AS rf FROM lineitem",
    "fx_call_direct": "SELECT fn AS caller, ok, ln, tgt AS callee, CASE rf WHEN 'N' THEN 'Direct' WHEN 'A' THEN 'Indirect' ELSE 'Conservative' END AS kind FROM fx_line WHERE q <= 2",
    "fx_call_indirect": "SELECT fn AS caller, ok, ln FROM fx_line WHERE q = 3 AND sk % 10 = 0",
    "fx_addr_ref": "SELECT DISTINCT tgt AS v, fn AS f FROM fx_line WHERE q = 4 AND tax = 0.08",
    "fx_seed": "SELECT sym FROM fx_fn WHERE fname = 'main' OR fname LIKE 'globals%'",
    "fx_trace": "SELECT event_id, (user_id + 1) * 2 + event_id % 2 AS site, event_id % 50 AS val FROM events",
    "fx_section": "SELECT s_suppkey AS sec, s_suppkey * 1000 AS start_addr, 400 + s_nationkey * 20 AS size_bytes FROM supplier",
    "fx_addr": "SELECT o_orderkey, (o_orderkey * 137) % ((SELECT max(s_suppkey) + 1 FROM supplier) * 1000) AS addr FROM orders",
    "fx_segment": "SELECT c_custkey AS seg, c_custkey * 20 AS lo, c_custkey * 20 + 5 + c_nationkey AS hi FROM customer",
    "fx_stream": "SELECT o_custkey AS fn, o_orderkey AS pos, CAST(floor(o_totalprice) AS BIGINT) % 1000 AS word FROM orders",
    "fx_vuln": "SELECT * FROM (VALUES ('V-1', 'Brand#1', '<=1.5.3', 'f_%'), ('V-2', 'Brand#2', '>=0.3.0|<1.2.0', 'f_%'), ('V-3', 'Brand#3', '=2.4.1', 'f_%'), ('V-4', 'Brand#99', '>1.0.0', 'f_%')) AS t(cve_id, component, version_range, fname_pattern) UNION ALL SELECT 'V-5', p_brand, '>=0.0.0', 'f_1' FROM part WHERE p_partkey = 1",
    "fx_call": "SELECT caller AS src, callee AS dst, kind FROM fx_call_direct",
    "fx_arg": "SELECT fn, ln AS arg_no, tgt AS value FROM fx_line WHERE q <= 3",
    "fx_assign": "SELECT DISTINCT fn AS dst, tgt AS src FROM fx_line WHERE q = 2 AND rf = 'R'",
    "fx_store": "SELECT DISTINCT fn AS dst, tgt AS src FROM fx_line WHERE q = 1 AND rf = 'A'",
    "fx_instr": "SELECT fn, ok * 10 + ln AS pos, CASE ln WHEN 1 THEN 'store' WHEN 2 THEN 'load' WHEN 3 THEN 'phi' WHEN 4 THEN 'call' WHEN 5 THEN 'ret' WHEN 6 THEN 'bitcast' ELSE 'atomicrmw' END AS opcode, ok AS dst, tgt AS a, CASE WHEN sk % 4 <> 0 THEN sk END AS b FROM fx_line",
    "fx_model_call": "SELECT concat(CAST(ok AS STRING), '_', CAST(ln AS STRING)) AS site, CASE fn % 6 WHEN 0 THEN 'malloc' WHEN 1 THEN 'realloc' WHEN 2 THEN 'memcpy' WHEN 3 THEN 'pthread_create' WHEN 4 THEN 'qsort' ELSE 'puts' END AS name, CAST(tgt AS STRING) AS a, CAST(sk AS STRING) AS b, concat('f', CAST(fn AS STRING)) AS c, concat('g', CAST(fn AS STRING)) AS d FROM fx_line",
    "fx_model_more": "SELECT concat(CAST(ok AS STRING), '_', CAST(ln AS STRING)) AS site, CASE fn % 9 WHEN 0 THEN '__mmap' WHEN 1 THEN 'shmat' WHEN 2 THEN 'fopencookie' WHEN 3 THEN 'qsort_r@GLIBC_2.8' WHEN 4 THEN '_ZNSt6thread15_M_start_threadESt10unique_ptrINS_6_StateESt14default_deleteIS1_EEPFvvE' WHEN 5 THEN 'posix_memalign' WHEN 6 THEN 'strstr' WHEN 7 THEN '_ZSt18_Rb_tree_incrementPSt18_Rb_tree_node_base' ELSE 'strtol' END AS name, CAST(tgt AS STRING) AS a, CAST(sk AS STRING) AS b, concat('f', CAST(fn AS STRING)) AS c, concat('g', CAST(fn AS STRING)) AS d, concat('h', CAST(sk AS STRING)) AS e FROM fx_line",
    "fx_constant": "SELECT fn, (ok * 10 + ln) * 3 AS id, (ok * 10 + sk % 2) * 3 + 1 AS parent, CASE WHEN q <= 2 THEN 'global' ELSE 'data' END AS kind, tgt AS node FROM fx_line UNION ALL SELECT min(fn), (ok * 10 + sk % 2) * 3 + 1, ok * 3 + 2, 'aggregate', -2 - (ok * 10 + sk % 2) * 3 FROM fx_line GROUP BY ok, sk % 2 UNION ALL SELECT min(fn), ok * 3 + 2, CAST(NULL AS BIGINT), 'aggregate', -3 - ok * 3 FROM fx_line GROUP BY ok",
    "an_site": "SELECT CAST(fn AS STRING) AS fn, concat(CAST(fn AS STRING), ':', CAST(ok AS STRING), '_', CAST(ln AS STRING)) AS site, q, CAST(tgt AS STRING) AS tgt, sk, tax FROM fx_line",
    "an_name": "SELECT CAST(sym AS STRING) AS node, CASE WHEN sym % 501 = 5 THEN 'pthread_create' ELSE fname END AS name FROM fx_fn",
    "an_call": "SELECT site, CASE WHEN q <= 2 THEN tgt ELSE site END AS callee FROM an_site WHERE q <= 2 OR (q = 3 AND sk % 10 = 0)",
    "an_edge": "SELECT 'Store' AS rel, site AS dst, tgt AS src FROM an_site WHERE q = 4 AND tax = 0.08 UNION ALL SELECT 'Store' AS rel, tgt AS dst, CAST(sk AS STRING) AS src FROM an_site WHERE q = 4 AND tax = 0.07 UNION ALL SELECT 'Assign' AS rel, site AS dst, tgt AS src FROM an_site WHERE q = 4 AND tax = 0.06",
    "an_gassign": "SELECT DISTINCT CAST(tgt AS STRING) AS dst, CAST((tgt * 7 + sk) % (SELECT max(p_partkey) + 1 FROM part) AS STRING) AS src FROM fx_line WHERE q = 4 AND tax = 0.05",
    "an_gstore": "SELECT DISTINCT CAST(fn AS STRING) AS dst, CAST(tgt AS STRING) AS src FROM fx_line WHERE q = 4 AND (tax = 0.04 OR tax = 0.05)",
    "fx_step": "SELECT CAST(caller AS STRING) AS target, CAST(row_number() OVER (PARTITION BY caller ORDER BY ok, ln) - 1 AS BIGINT) AS pos, ok * 10 + ln AS addr FROM fx_call_direct",
    "fx_place": "SELECT DISTINCT o_orderkey * 10 + o_custkey % 7 AS addr, concat('fn_', CAST(o_custkey AS STRING)) AS name, concat(CASE WHEN o_custkey % 3 = 0 THEN '/usr/' ELSE 'src/' END, CAST(o_custkey % 10 AS STRING), '.c') AS file, o_custkey AS line, o_orderkey % 80 AS col, o_custkey + 1 AS end_line, o_orderkey % 80 + 2 AS end_col FROM orders",
    "fx_load": "SELECT DISTINCT tgt AS dst, fn AS src FROM fx_line WHERE q = 3 AND rf = 'A' AND sk % 3 = 0",
    # functions that are suppliers: edges of all lines between their locals and parts
    "fd_edge": "SELECT DISTINCT concat('0x', CAST(l_suppkey AS STRING)) AS fn, concat('0x', CAST(l_suppkey AS STRING), ':0x', CAST(l_orderkey % 10 AS STRING)) AS dst, CASE WHEN l_linenumber % 2 = 0 THEN concat('0x', CAST(l_partkey + 100000 AS STRING)) ELSE concat('0x', CAST(l_suppkey AS STRING), ':0x', CAST(l_partkey % 10 AS STRING)) END AS src FROM lineitem",
    "fd_fn": "SELECT concat('0x', CAST(s_suppkey AS STRING)) AS fn, CAST(s_nationkey % 7 AS BIGINT) AS num_allocas, CASE WHEN s_suppkey % 4 > 0 THEN s_name END AS component, CASE WHEN s_suppkey % 4 > 0 THEN concat('1.', CAST(s_nationkey AS STRING)) END AS version FROM supplier",
    # frames: a function's locals are its lines, each with an edge
    "gf_local": "SELECT fn, CAST(row_number() OVER (PARTITION BY fn ORDER BY ok, ln, tgt, q, sk) - 1 AS BIGINT) AS local, concat('v', CAST(ln AS STRING)) AS name, ok, CAST(ln AS BIGINT) AS ln, tgt, q FROM fx_line",
    "gf_edge": "SELECT fn, CASE WHEN q <= 15 THEN 'Call' WHEN q <= 25 THEN 'Assign' WHEN q <= 35 THEN 'ArgumentSupply' ELSE 'Store' END AS rel, CASE WHEN q <= 35 THEN fn ELSE tgt END AS to_symbol, CASE WHEN q <= 35 THEN local END AS to_local, CASE WHEN q <= 15 OR (q > 25 AND q <= 35) THEN tgt ELSE fn END AS from_symbol, CASE WHEN q > 15 AND q <= 25 THEN ok % 10 WHEN q > 35 THEN local END AS from_local, CASE WHEN q <= 15 OR (q > 25 AND q <= 35) THEN ln END AS idx FROM gf_local",
    "gf_fn": "SELECT sym AS fn, CASE WHEN sym % 4 > 0 THEN component END AS component, CASE WHEN sym % 4 > 0 THEN version END AS version, CAST(sym % 3 AS BIGINT) AS num_allocas FROM fx_fn",
    # headers and the ports' documents below five folders
    "hp_header": "SELECT DISTINCT concat('/r', CAST(p_partkey % 5 AS STRING)) AS root, concat('/r', CAST(p_partkey % 5 AS STRING), CASE p_partkey % 4 WHEN 0 THEN '/include/' WHEN 1 THEN '/lib/include/' WHEN 2 THEN concat('/include/d', CAST(p_partkey % 13 AS STRING), '/') ELSE '/other/' END, 'h', CAST(p_partkey % 50 AS STRING), CASE WHEN p_partkey % 3 = 0 THEN concat('_', CAST(p_partkey AS STRING)) ELSE '' END, CASE p_partkey % 7 WHEN 0 THEN '.hpp' WHEN 1 THEN '.c' ELSE '.h' END) AS path FROM part",
    "hp_port": "SELECT concat('/r', CAST(s_suppkey % 5 AS STRING)) AS root, concat('/r', CAST(s_suppkey % 5 AS STRING), CASE WHEN s_suppkey % 6 = 5 THEN '/doc/' ELSE '/share/' END, CAST(s_suppkey AS STRING), '/vcpkg.spdx.json') AS path, CASE WHEN s_suppkey % 2 = 0 THEN concat('h', CAST(s_suppkey % 50 AS STRING)) ELSE concat('d', CAST(s_suppkey % 13 AS STRING)) END AS name, concat('1.', CAST(s_nationkey AS STRING)) AS version FROM supplier",
    "sk_symbol": "SELECT s_suppkey * 1000 AS addr, CASE s_suppkey % 3 WHEN 0 THEN concat('_ZN3lib8fn', lpad(CAST(s_suppkey AS STRING), 6, '0'), 'Ev') WHEN 1 THEN concat('_Z?', CAST(s_suppkey AS STRING)) ELSE concat('fn', CAST(s_suppkey AS STRING)) END AS name, 400 + s_nationkey * 20 AS size FROM supplier",
    "sk_local": "SELECT l_suppkey AS fn, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS local, concat('up|', CASE WHEN l_linenumber % 2 = 0 THEN 'i.' ELSE 'p->' END, CAST(l_linenumber AS STRING)) AS debug FROM lineitem",
    # a request for each supplier: a path from one function by way of a second to a third
    "pw_start": "SELECT s_suppkey AS request, (s_suppkey * 131) % (SELECT max(p_partkey) + 1 FROM part) AS start FROM supplier",
    "pw_stop": "SELECT request, 0 AS pos, start AS node FROM pw_start UNION ALL SELECT request, 1, max(callee) FROM pw_start LEFT JOIN fx_call_direct ON caller = start GROUP BY request UNION ALL SELECT request, 2, (start * 29 + 11) % (SELECT max(p_partkey) + 1 FROM part) FROM pw_start",
    "pw_target": "SELECT DISTINCT (s_suppkey * 17 + 3) % (SELECT max(p_partkey) + 1 FROM part) AS node FROM supplier",
    # bodies that hold each other or are apart: suppliers' of 900, customers' of 55 mostly within them, nations' around all
    "nb_body": "SELECT concat('s', CAST(s_suppkey AS STRING)) AS fn, s_suppkey * 1000 AS low, s_suppkey * 1000 + 900 AS high FROM supplier UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), c_custkey * 100 + 5, c_custkey * 100 + 60 FROM customer UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), n_nationkey * 40000 - 10, n_nationkey * 40000 + 39000 FROM nation",
    "nb_point": "SELECT o_orderkey, (o_orderkey * 137) % ((SELECT max(s_suppkey) + 1 FROM supplier) * 1000) AS addr FROM orders",
    "tv_site": "SELECT DISTINCT site AS addr, site * 65536 + 1 AS node FROM fx_trace",
    "tv_edge": "SELECT site, CASE WHEN event_id % 3 = 0 THEN val * 2 + 2 ELSE (event_id * 7919) % 400000 END AS value FROM fx_trace",
    # facts of the two-phase analysis, of every line: symbols are multiples of 1000, a function's locals follow its own one, its call sites come from the 100th on
    "tp_line": "SELECT l_partkey * 1000 AS fn, CAST(l_quantity AS BIGINT) AS q, l_partkey * 1000 + 1 + l_orderkey % 11 AS a, l_partkey * 1000 + 1 + l_suppkey % 13 AS b, l_partkey * 1000 + 100 + l_orderkey % 5 AS site, (l_orderkey * 31 + l_suppkey * 17 + l_linenumber * 7) % (SELECT max(p_partkey) + 1 FROM part) * 1000 AS tgt, CAST(l_linenumber % 3 AS BIGINT) AS i FROM lineitem",
    "tp_edge": "SELECT DISTINCT CASE WHEN q <= 2 THEN 'Call' WHEN q <= 8 THEN 'Assign' WHEN q <= 14 THEN 'Load' WHEN q <= 20 THEN 'Store' WHEN q <= 21 THEN 'Return' WHEN q <= 23 THEN 'ArgumentSupply' ELSE 'ArgumentDefinition' END AS rel, fn, CASE WHEN q IN (1, 2, 22, 23) THEN site WHEN q = 21 THEN fn ELSE a END AS dst, CASE WHEN q IN (1, 3, 15) THEN tgt WHEN q = 24 THEN fn ELSE b END AS src, CASE WHEN q >= 22 THEN i END AS idx FROM tp_line WHERE q <= 24",
    "tp_alloca": "SELECT DISTINCT fn, a AS v FROM tp_line WHERE q > 24 AND q <= 36",
    "tp_star": "SELECT DISTINCT fn, b * -1 AS starred, b AS node FROM tp_line WHERE q > 36",
    "tp_value": "SELECT fn, dst AS v FROM tp_edge UNION SELECT fn, src FROM tp_edge",
}


def ctes(*names: str) -> str:
    """The views that the named ones need, in order, as common table expressions."""
    need: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if other != name and other in VIEWS[name].replace(",", " ").replace(")", " ").split():
                add(other)
        if name not in need:
            need.append(name)

    for n in names:
        add(n)
    return ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view of this name over the tables of sf_dir."""
    text = f"WITH {ctes(name)} SELECT * FROM {name}"
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if f"FROM {t}" in text}
    for t in used:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"FROM {t})", f"FROM {{{t}}})")
    return spark.sql(text, **used)
