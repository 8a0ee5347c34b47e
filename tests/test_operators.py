"""Fixpoints, paths, points-to, lookups, lifting, models, triage and reports on small facts."""

import random

import pytest
from pyspark.sql import functions as F

from sparkreach.operators import andersen, facts, fixpoint, graph, lifting, lookups, ordered, overrides, reachability, reports, summaries, triage


def edges(spark, rows):
    return spark.createDataFrame(rows, "src bigint, dst bigint")


def nodes(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "node bigint")


def values(df, *columns):
    return {tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def brute_reach(seeds, pairs):
    seen, todo = set(seeds), list(seeds)
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def random_pairs(seed, n=30, m=50):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("hops", [1, 4])
def test_reach(spark, hops):
    pairs = random_pairs(hops)
    assert values(fixpoint.reach(nodes(spark, 0, 3), edges(spark, pairs), hops), "node") == brute_reach([0, 3], pairs)


def test_closure_and_slice(spark):
    pairs = random_pairs(9, 12, 18)
    e = edges(spark, pairs)
    every = {(a, b) for a in range(12) for b in brute_reach([y for x, y in pairs if x == a], pairs)}
    assert values(fixpoint.closure(e), "src", "dst") == every
    inner = (brute_reach([0], pairs) & brute_reach([5], [(b, a) for a, b in pairs])) | {0, 5}
    assert values(graph.slice_between(e, nodes(spark, 0), nodes(spark, 5)), "src", "dst") == {(a, b) for a, b in pairs if a in inner and b in inner}


def test_paths(spark):
    rows = [(0, 1, "Direct"), (1, 2, "Direct"), (0, 2, "Conservative"), (2, 3, "Indirect"), (0, 3, "Conservative"), (3, 3, "Direct")]
    calls = spark.createDataFrame(rows, "src bigint, dst bigint, kind string")
    path = graph.shortest(calls, nodes(spark, 0), nodes(spark, 3))
    assert sorted(values(path, "pos", "node", "cost")) == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 3, 12)]
    assert graph.rendered(path, calls).first()["text"] == "0 ---> 1 ---> 2 -I-> 3"
    via = graph.path_via(calls, [0, 2, 3])
    assert sorted(values(via, "leg", "pos", "node")) == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 2), (1, 1, 3)]
    assert graph.path_via(calls, [3, 0]) is None
    assert values(graph.roots(calls), "node") == {0}


def test_longest_from_roots(spark):
    e = edges(spark, [(1, 2), (2, 9), (5, 9)])
    assert values(graph.longest_from_roots(e, nodes(spark, 9)), "target", "root", "depth") == {(9, 1, 2)}


def test_longest_from_roots_of_many_targets(spark):
    e = edges(spark, [(1, 2), (9000, 3), (3, 4), (4, 3)] + [(2, i) for i in range(10, 1210)])
    expected = {(i, 1, 2) for i in range(10, 1210)} | {(4, 9000, 2)}
    assert values(graph.longest_from_roots(e, nodes(spark, *range(10, 1210), 4, 777777)), "target", "root", "depth") == expected


def test_reachability(spark):
    direct = edges(spark, [(0, 1), (1, 2), (7, 8)])
    refs = spark.createDataFrame([(7, 1), (9, 6)], "v bigint, f bigint")
    now, seen = reachability.simple(nodes(spark, 0), direct, nodes(spark, 2), refs)
    assert values(now, "node") == {0, 1, 2, 7, 8} and values(seen, "node") == {7}
    now, seen = reachability.simple(nodes(spark, 0), direct, nodes(spark, 8), refs)
    assert values(now, "node") == {0, 1, 2} and values(seen, "node") == {7}


def test_referenced_from(spark):
    rows = [("Assign", 100, 1), ("Store", 101, 2), ("Return", 3, 4), ("Load", 102, 5), ("Call", 100, 6)]
    e = spark.createDataFrame(rows, "rel string, dst bigint, src bigint")
    inside = spark.createDataFrame([(50, 100), (51, 101), (52, 102)], "fn bigint, local bigint")
    got = values(reachability.referenced_from(e, inside, nodes(spark, 1, 2, 3, 4, 5, 6)), "v", "f")
    assert got == {(1, 50), (2, 51), (5, 52)}


def brute_points(alloc, assign, load, store):
    pts = {}
    for n, o in alloc:
        pts.setdefault(n, set()).add(o)
    while True:
        before = sum(map(len, pts.values()))
        for d, s in assign:
            pts.setdefault(d, set()).update(pts.get(s, ()))
        for d, p in load:
            for o in set(pts.get(p, ())):
                pts.setdefault(d, set()).update(pts.get(o, ()))
        for p, v in store:
            for o in set(pts.get(p, ())):
                pts.setdefault(o, set()).update(pts.get(v, ()))
        if sum(map(len, pts.values())) == before:
            return {(n, o) for n, s in pts.items() for o in s}


@pytest.mark.parametrize("seed", [1, 2])
def test_points_to(spark, seed):
    rng = random.Random(seed)
    pair = lambda n: [(rng.randrange(15), rng.randrange(15)) for _ in range(n)]
    alloc, assign, load, store = [(i, i + 5) for i in range(6)], pair(10), pair(5), pair(5)
    two = lambda rows: spark.createDataFrame(rows, "dst bigint, src bigint")
    got = andersen.points_to(spark, spark.createDataFrame(alloc, "node bigint, obj bigint"), two(assign), two(load), two(store))
    assert values(got, "node", "obj") == brute_points(alloc, assign, load, store)


def test_points_to_calls(spark):
    """An indirect call through a variable: two targets, arguments and results bound."""
    two = lambda rows: spark.createDataFrame(rows, "dst string, src string")
    got = andersen.points_to(
        spark,
        spark.createDataFrame([("buf", "obj")], "node string, obj string"),
        two([("fp", "f"), ("fp", "g")]),
        two([]),
        two([]),
        funcs=spark.createDataFrame([("f",), ("g",)], "node string"),
        calls=spark.createDataFrame([("cs", "fp")], "site string, callee string"),
        supply=spark.createDataFrame([("cs", 0, "buf")], "site string, arg_no bigint, value string"),
        params=spark.createDataFrame([("f", 0, "fa"), ("g", 0, "ga")], "fn string, arg_no bigint, value string"),
        returns=spark.createDataFrame([("f", "fa")], "fn string, value string"),
    )
    found = values(got, "node", "obj")
    assert {("fp", "f"), ("fp", "g"), ("fa", "obj"), ("ga", "obj"), ("cs", "obj")} <= found and ("cs", "f") not in found


def test_two_phases(spark):
    """Solving the summaries reaches what solving the raw facts does."""
    rows = [("Assign", 1, 11, 2, None), ("Assign", 1, 12, 11, None), ("Call", 1, 10, 12, 0), ("Call", 2, 20, 3, 0), ("Call", 4, 40, 5, 0)]
    e = spark.createDataFrame(rows, "rel string, fn bigint, dst bigint, src bigint, idx bigint")
    symbols, inside = nodes(spark, 1, 2, 3, 4, 5), spark.createDataFrame([(1, 10), (2, 20), (4, 40)], "fn bigint, local bigint")
    calls, now = summaries.solve(e, symbols, inside, nodes(spark, 1))
    assert values(calls, "site", "callee") == {(10, 2), (20, 3), (40, 5)} and values(now, "node") == {1, 2, 3}
    small = summaries.summarise(e, symbols, nodes(spark))
    again = summaries.solve(small, symbols, inside, nodes(spark, 1))[1]
    assert values(again, "node") == {1, 2, 3}


def starred_brute(assign, loads, stores, stars, congruent):
    vs = {v for pair in (*assign, *loads, *stores, *stars) for v in pair}
    found = {(v, v) for v in vs} | set(assign)
    while True:
        new = {(a, d) for a, b in found for c, d in found if b == c}
        # what may be stored at p, and what may be loaded from it
        at = {(p, val) for q, val in stores for x, p in found if x == q}
        new |= {(into, val) for into, q in loads for x, p in found if x == q for p2, val in at if p2 == p}
        new |= {(s, val) for s, n in stars for p, val in at if p == n}
        new |= {(into, s) for into, q in loads for x, p in found if x == q for s, n in stars if n == p}
        if congruent:
            new |= {(s, t) for s, n in stars for t, m in stars if (n, m) in found}
        if new <= found:
            return found
        found |= new


@pytest.mark.parametrize(("seed", "congruent"), [(1, False), (2, True), (3, True)])
def test_starred_substitutions(spark, seed, congruent):
    r = random.Random(seed)
    pair = lambda: (r.randrange(8), r.randrange(8))
    assign, loads, stores = [pair() for _ in range(3)], [pair() for _ in range(2)], [pair() for _ in range(2)]
    stars = [(100 + v, v) for v in range(8)] + [(200 + v, 100 + v) for v in range(3)]
    rows = [("Assign", 1, *p, None) for p in assign] + [("Load", 1, *p, None) for p in loads] + [("Store", 1, *p, None) for p in stores]
    e = spark.createDataFrame(rows, "rel string, fn bigint, dst bigint, src bigint, idx bigint")
    got = values(summaries.substitutions(e, ["fn"], spark.createDataFrame(stars, "starred bigint, node bigint"), congruent), "x", "y")
    known = {v for p in (*assign, *loads, *stores) for v in p}
    known |= {100 + v for v in known if v < 100}
    known |= {200 + v - 100 for v in known if 100 <= v < 103}
    want = {p for p in starred_brute(assign, loads, stores, [s for s in stars if s[1] in known], congruent)}
    assert got == want


def test_lookups(spark):
    ranges = spark.createDataFrame([(1, 100, 50), (2, 200, 10), (3, 70000, 70000)], "id bigint, start bigint, size bigint")
    points = spark.createDataFrame([(a,) for a in (99, 100, 149, 150, 209, 210, 70000, 139999, 140000)], "at bigint")
    got = dict(values(ordered.floor_join(points, "at", ranges, "start", "size"), "at", "id"))
    assert got == {99: None, 100: 1, 149: 1, 150: None, 209: 2, 210: None, 70000: 3, 139999: 3, 140000: None}
    rng = random.Random(1)
    spans = [(a, a + rng.randrange(30)) for a in (rng.randrange(900) for _ in range(60))]
    df = spark.createDataFrame(spans, "lo bigint, hi bigint")
    covered = {x for a, b in spans for x in range(a, b)}
    joined = sorted(values(ordered.interval_union(df, "lo", "hi"), "lo", "hi"))
    assert {x for a, b in joined for x in range(a, b)} == covered and all(a[1] < b[0] for a, b in zip(joined, joined[1:]))
    inside = ordered.within(spark.range(0, 1000).select(F.col("id").alias("at")), "at", df, "lo", "hi")
    assert values(inside, "at") == covered


def test_delta_round_trip(spark):
    rows = [(f, i, (i * 37 + f) % 101) for f in range(3) for i in range(20)]
    df = lookups.delta_encode(spark.createDataFrame(rows, "fn bigint, pos bigint, x bigint"), ["fn"], "pos", "x")
    back = lookups.delta_decode(df.select("fn", "pos", "x", "delta"), ["fn"], "pos", "delta")
    assert back.where("x <> value").count() == 0 and back.count() == 60


def test_lifting(spark):
    rows = [
        (1, 0, "store", None, [10, 11], None, None, "", 0, False),
        (1, 1, "load", 12, [11], None, None, "", 0, False),
        (1, 2, "phi", 13, [10, None, 12], None, None, "", 0, False),
        (1, 3, "call", 14, [12, 13], 2, "f", "", 2, False),
        (1, 4, "ret", None, [14], None, None, "", 0, False),
        (1, 5, "call", 15, [10, 11], 3, "llvm.memcpy.p0", "", 2, False),
        (1, 6, "atomicrmw", 16, [11, 12], None, None, "", 0, False),
        (1, 7, "call", 17, [10], 4, "dlsym", "", 1, False),
    ]
    df = spark.createDataFrame(rows, "fn bigint, pos bigint, opcode string, dst bigint, operands array<bigint>, callee bigint, callee_name string, x string, nargs bigint, callee_is_local boolean")
    got = values(lifting.lift(df), "rel", "dst", "src", "idx")
    assert got == {("Store", 11, 10, None), ("Load", 12, 11, None), ("Assign", 13, 10, None), ("Assign", 13, 12, None), ("Call", 14, 2, 2), ("ArgumentSupply", 14, 12, 0), ("ArgumentSupply", 14, 13, 1), ("Return", 1, 14, None), ("Load", -6, 11, None), ("Store", 10, -6, None), ("Load", 16, 11, None), ("Store", 11, 12, None), ("Dlsym", 17, 17, None)}


def test_overrides(spark):
    rows = [("c1", "malloc@GLIBC", []), ("c2", "realloc", ["p", "n"]), ("c3", "memcpy", ["d", "s", "n"]), ("c4", "pthread_create", ["t", "a", "fn", "arg"])]
    calls = spark.createDataFrame(rows, "site string, name string, args array<string>")
    got = values(overrides.edges(calls), "rel", "dst", "src")
    assert {("Alloc", "c1", "heap:c1"), ("Alloc", "c2", "heap:c2"), ("Assign", "c2", "p"), ("Assign", "c3", "d"), ("Load", "tmp:c3", "s"), ("Store", "d", "tmp:c3"), ("IndirectCall", "c4", "fn"), ("Pass", "c4", "arg")} == got


def test_more_overrides(spark):
    rows = [("c1", "fopencookie", ["k", "mode", "fs"]), ("c2", "qsort_r", ["b", "n", "s", "cmp", "ctx"]), ("c3", overrides.THREAD, ["this", "state", "run"]), ("c4", "shmat", ["id", "at", "0"]), ("c5", "strtol", ["s", "e", "10"])]
    got = values(overrides.edges(spark.createDataFrame(rows, "site string, name string, args array<string>")), "rel", "dst", "src")
    cookie = {("Alloc", "c1", "heap:c1"), ("Store", "c1", "k"), ("Load", "tmp:c1", "fs"), ("Store", "c1", "tmp:c1")}
    assert got == cookie | {("IndirectCall", "c2", "cmp"), ("Pass", "c2", "b"), ("Pass", "c2", "ctx"), ("IndirectCall", "c3", "run"), ("Alloc", "c4", "heap:c4"), ("Assign", "c4", "at")}


def test_variadic_lists(spark):
    functions = spark.createDataFrame([(1, 2, 90, 91, 92)], "fn bigint, n_params bigint, list bigint, area bigint, rest bigint")
    assert values(lifting.variadic(functions), "rel", "dst", "src", "idx") == {("ArgumentDefinition", 92, 1, 2), ("Store", 91, 92, None), ("Store", 90, 91, None)}
    rows = [(1, 4, "call", None, [30], 7, "llvm.va_start.p0", 1), (2, 5, "call", None, [31], 7, "llvm.va_start.p0", 1)]
    calls = spark.createDataFrame(rows, "fn bigint, pos bigint, opcode string, dst bigint, operands array<bigint>, callee bigint, callee_name string, nargs bigint")
    assert values(lifting.lift(calls, lists=functions), "rel", "fn", "dst", "src") == {("Load", 1, -5, 90), ("Store", 1, 30, -5)}


def test_constants(spark):
    rows = [(1, 1, None, "aggregate", -1), (1, 2, 1, "global", 50), (1, 3, 1, "data", None), (1, 4, 1, "aggregate", -4), (1, 5, 4, "global", 51), (1, 6, 4, "data", None), (1, 7, None, "aggregate", -7), (1, 8, 7, "data", None), (2, 9, None, "aggregate", -9)]
    nodes_, assigns = lifting.constants(spark.createDataFrame(rows, "fn bigint, id bigint, parent bigint, kind string, node bigint"))
    assert dict(values(nodes_, "id", "node")) == {1: -1, 2: 50, 3: None, 4: 51, 5: 51, 6: None, 7: None, 8: None, 9: None}
    assert values(assigns, "rel", "fn", "dst", "src") == {("Assign", 1, -1, 50), ("Assign", 1, -1, 51)}


def test_facts(spark):
    uses = spark.createDataFrame([(1, "data"), (1, "undefined"), (2, "function"), (2, "data"), (3, "undefined")], "node bigint, state string")
    assert values(facts.node_state(uses), "node", "state") == {(1, "data"), (2, "conflict"), (3, "undefined")}
    with pytest.raises(Exception, match="two states"):
        facts.checked(facts.node_state(uses), F.col("state") == "conflict", "two states").collect()
    assert values(facts.undefined(nodes(spark, 1, 2, 3), nodes(spark, 1), nodes(spark, 2)), "node") == {3}


def test_triage(spark):
    vulns = spark.createDataFrame([("A", "z", "<2.0.0", "inflate"), ("B", "z", "<1.0.0", "inflate"), ("C", "m", ">=0.0.0", "f%"), ("D", "none", ">=0.0.0", "f")], "cve_id string, component string, version_range string, fname_pattern string")
    functions = spark.createDataFrame([(1, "inflate", "z", "1.2.12#2"), (2, "fa", "m", "1.0.0"), (3, "fb", "m", "1.0.0"), (4, "fc", "m", "bad")], "sym bigint, fname string, component string, version string")
    got = triage.run(vulns, functions, nodes(spark, 1, 3))
    assert values(got, "cve_id", "classification", "n_targets", "n_reachable") == {("A", "potentially reachable", 1, 1), ("B", "unreachable", 0, 0), ("C", "potentially reachable", 2, 1), ("D", "unreachable", 0, 0)}
    required = spark.createDataFrame([("A", "deflate")], "cve_id string, name string")
    judged = triage.run(vulns, functions, nodes(spark, 1, 3), [triage.required_symbols(required, functions, nodes(spark, 1, 3))])
    assert dict(values(judged, "cve_id", "classification"))["A"] == "unreachable"


def test_reports(spark):
    import json

    results = spark.createDataFrame([("V", "reachable", "seen", "bad"), ("W", "reachable", "seen", "bad")], "cve_id string, classification string, justification string, function string")
    traces = spark.createDataFrame([(t, i, 70 + i) for t, n in (("V", 5), ("W", 2)) for i in range(n)], "target string, pos bigint, addr bigint")
    places = [(70 + i, f"f{i}", f"{'/usr' if i == 4 else 's'}/{i}.c", 10 + i, 1, 20 + i, 2) for i in range(5)]
    lines = spark.createDataFrame(places, "addr bigint, name string, file string, line int, col int, end_line int, end_col int")
    flows = reports.steps(traces, lines)
    assert [tuple(r) for r in flows.where("target = 'V'").orderBy("pos").select("pos", "nesting", "is_last").collect()] == [(1, 1, False), (3, 2, False), (4, 3, True)]  # callers go, the target stays
    log = json.loads("".join(r["line"] for r in reports.sarif_log(reports.sarif(results, flows, traces, lines)).orderBy("pos", "line").collect()))
    found = {r["ruleId"]: r for r in log["runs"][0]["results"]}
    assert log["version"] == "2.1.0" and found["V"]["message"]["text"] == "[V] REACHABLE\nseen."
    assert [x["location"]["physicalLocation"]["artifactLocation"]["uri"] for x in found["V"]["codeFlows"][0]["threadFlows"][0]["locations"]] == ["s/1.c", "s/3.c", "file:///usr/4.c"]
    assert found["V"]["locations"][0]["physicalLocation"]["region"] == {"startLine": 13, "startColumn": 1, "endLine": 23, "endColumn": 2}
    issues = {r["cve_id"]: json.loads(r["row"]) for r in reports.code_quality(results, traces, lines, True).collect()}
    assert issues["V"]["location"] == {"path": "s/3.c", "lines": {"begin": 13, "end": 23}} and "from call site in f3" in issues["V"]["description"]
    assert "Vulnerable function bad reachable at address 0x47" in issues["W"]["description"]
    summary = reports.callee_summary(spark.createDataFrame([("a", "f"), ("b", "g"), ("b", "*h")], "src string, dst string"))
    assert values(summary, "src") == {"b"}
    lines = [r["line"] for r in reports.dot(spark.createDataFrame([("a", 'b"')], "src string, dst string")).orderBy("pos").collect()]
    assert lines == ["digraph {", '  "a" -> "b\\"";', "}"]


def test_analysis_of_threads_and_stores(spark):
    """Code reached only through a thread start, and through a store to a referenced global, is reachable; without an indirect call it is not."""
    from sparkreach.operators import reachability

    text = lambda rows, shape: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in shape.split()))
    names = [("m", "main"), ("p", "pthread_create"), ("w", "worker"), ("g", "table"), ("h", "hook"), ("u", "unused")]
    edges = [("Assign", "m:1", "w"), ("Load", "m:2", "g"), ("Store", "g", "h"), ("Assign", "u:1", "u")]
    facts = {"edges": text(edges, "rel dst src"), "enclosing": text([("m", "m:1"), ("m", "m:2"), ("m", "m:9"), ("u", "u:1")], "fn local"), "symbols": text([(n,) for n, _ in names], "node"), "names": text(names, "node name"), "seeds": text([("m",)], "node")}
    found = reachability.analysis(facts | {"calls": text([("m:9", "p")], "site callee")})
    assert {r["node"] for r in found["reachable"].collect()} == {"m", "p", "w", "g", "h"}
    assert {(r["callee"], r["kind"]) for r in found["callgraph"].collect()} == {("p", "Direct"), ("w", "Conservative"), ("g", "Conservative"), ("h", "Conservative")}
    assert ("m", "main", "h", "hook", "Conservative") in {tuple(r) for r in found["named"].collect()}
    found = reachability.analysis(facts | {"calls": text([("m:9", "u")], "site callee")})
    assert {r["node"] for r in found["reachable"].collect()} == {"m", "u"} and {r["node"] for r in found["referenced"].collect()} == {"w", "g", "h", "u"}
