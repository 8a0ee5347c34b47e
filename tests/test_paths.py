"""Path searches for many requests, verdicts by waypoints, and rules, against plain Python."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from sparkreach.operators import andersen, graph, lifting, rules, strategies, triage


def rows(df, *c):
    return sorted((tuple(r[x] for x in c) for r in df.collect()), key=repr)


def random_graph(seed, n=40, m=70):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n), rng.choice(["Direct", "Indirect", "Other"])) for _ in range(m)})


def dijkstra(edges, start):
    cost, heap = {}, [(0, start)]
    while heap:
        c, x = heapq.heappop(heap)
        if x in cost:
            continue
        cost[x] = c
        for a, b, k in edges:
            if a == x and b not in cost:
                heapq.heappush(heap, (c + {"Direct": 1, "Indirect": 10}.get(k, 100), b))
    return cost


@pytest.mark.parametrize("seed", [1, 2])
def test_through(spark, seed):
    """Costs of all legs; requests with a stop that is missing or out of reach have no path; repeated stops."""
    edges, rng = random_graph(seed), random.Random(seed)
    stops = {f"r{i}": [rng.randrange(12) for _ in range(rng.choice([2, 3, 4]))] for i in range(25)}
    stops["lost"], stops["same"] = [1, None, 2], [3, 3, 3]
    calls = spark.createDataFrame(edges, "src bigint, dst bigint, kind string")
    asked = spark.createDataFrame([(r, p, n) for r, s in stops.items() for p, n in enumerate(s)], "request string, pos int, node bigint")
    found = {}
    for r, leg, pos, n, c in rows(graph.through(calls, asked), "request", "leg", "pos", "node", "cost"):
        found.setdefault(r, {}).setdefault(leg, {})[pos] = (n, c)
    cheap = {(a, b): min({"Direct": 1, "Indirect": 10}.get(k, 100) for x, y, k in edges if (x, y) == (a, b)) for a, b, _ in edges}
    for r, s in stops.items():
        costs = [dijkstra(edges, a).get(b) if a is not None and b is not None else None for a, b in zip(s, s[1:])]
        if None in costs:
            assert r not in found
            continue
        assert sorted(found[r]) == list(range(len(s) - 1))
        for leg, (a, b, c) in enumerate(zip(s, s[1:], costs)):
            path = [found[r][leg][p] for p in range(len(found[r][leg]))]
            assert path[0] == (a, 0) and path[-1] == (b, c)
            assert all(y[1] - x[1] == cheap[x[0], y[0]] for x, y in zip(path, path[1:]))


@pytest.mark.parametrize("seed", [3, 4])
def test_path_or_root(spark, seed, monkeypatch):
    """Shortest from the start, else the longest of the shortest from roots, else the target alone; more targets than a word holds."""
    edges = sorted({(a, b) for a, b, _ in random_graph(seed, 120, 130)})
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    targets = list(range(0, 120)) + [999]
    found = {}
    for t, p, n in rows(graph.path_or_root(df, spark.createDataFrame([(edges[0][0],)], "node bigint"), spark.createDataFrame([(t,) for t in targets] + [(None,)], "node bigint")), "target", "pos", "node"):
        found.setdefault(t, {})[p] = n
    roots = {a for a, _ in edges} - {b for _, b in edges}
    for t in targets:
        depth, level = {t: 0}, [t]
        while level:
            level = sorted({a for a, b in edges if b in level and a not in depth})
            depth |= {a: depth[b] + 1 for a in level for b in [next(y for x, y in edges if x == a and y in depth)]} and {a: 1 + min(depth[y] for x, y in edges if x == a and y in depth) for a in level}
        begin = edges[0][0] if edges[0][0] in depth else max((r for r in roots if r in depth), key=lambda r: (depth[r], r), default=t)
        path = [found[t][p] for p in range(len(found[t]))]
        assert path[0] == begin and path[-1] == t and len(path) == depth[begin] + 1
        assert all(e in edges for e in zip(path, path[1:]))


def test_waypoint_verdicts(spark):
    """A missing waypoint, one that is not on a way, one that is, none; the other path is named."""
    calls = spark.createDataFrame([(1, 2, "Direct"), (2, 3, "Direct"), (1, 4, "Direct"), (4, 5, "Direct")], "src bigint, dst bigint, kind string")
    names = spark.createDataFrame([(1, "main"), (2, "a"), (3, "bad"), (4, "b"), (5, "c"), (6, "far")], "sym bigint, fname string")
    way = spark.createDataFrame([("V1", 0, "a"), ("V2", 0, "b"), ("V3", 0, "nowhere"), ("V5", 0, "a"), ("V5", 1, "b")], "cve_id string, pos int, name string")
    targets = spark.createDataFrame([(v, 3, "bad") for v in ("V1", "V2", "V3", "V4", "V5")] + [("V4", 6, "far")], "cve_id string, sym bigint, fname string")
    judge = triage.waypoints(calls, spark.createDataFrame([(1,)], "node bigint"), way, names)
    assert rows(judge(targets), "cve_id", "sym", "verdict", "note") == [
        ("V1", 3, None, "path: main > a > bad"),
        ("V2", 3, "unreachable", "bad has no path through b; another path: main > a > bad"),
        ("V3", 3, "unreachable", "bad needs a waypoint that is not in the program: nowhere"),
        ("V4", 3, None, "path: main > a > bad"),
        ("V4", 6, "unreachable", "far has no path through the call graph"),
        ("V5", 3, "unreachable", "bad has no path through a, b; another path: main > a > bad"),
    ]
    merged = triage.merge(targets, triage.apply(targets, [judge]))
    assert [r["address"] for r in merged.orderBy("cve_id").collect()] == [3, None, None, 3, None]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rules(spark, seed):
    """Mutual recursion, constants, repeated variables, facts of a made relation, relations that nothing feeds."""
    rng = random.Random(seed)
    e = {(rng.randrange(12), rng.randrange(12)) for _ in range(16)}
    mark = {(rng.randrange(12),) for _ in range(3)}
    program = [
        rules.rule(("even", "x", "y"), ("edge", "x", "z"), ("odd", "z", "y")),
        rules.rule(("odd", "x", "y"), ("edge", "x", "y")),
        rules.rule(("odd", "x", "y"), ("edge", "x", "z"), ("even", "z", "y")),
        rules.rule(("loop", "x"), ("even", "x", "x")),
        rules.rule(("from_one", "y", rules.is_(7)), ("odd", rules.is_(1), "y")),
        rules.rule(("mark", "y"), ("mark", "x"), ("edge", "x", "y")),
        rules.rule(("none", "x"), ("none", "x"), ("edge", "x", rules.ANY)),
    ]
    got = rules.evaluate(program, {"edge": spark.createDataFrame(list(e), "a bigint, b bigint"), "mark": spark.createDataFrame(list(mark), "v bigint")})
    odd, even = set(e), set()
    while True:
        new = {(x, y) for x, z in e for w, y in odd if w == z} - even, {(x, y) for x, z in e for w, y in even if w == z} - odd
        if not any(new):
            break
        even |= new[0]
        odd |= new[1]
    reached = {m for (m,) in mark}
    while (more := {b for a, b in e if a in reached} - reached):
        reached |= more
    assert set(map(tuple, got["odd"].collect())) == odd and set(map(tuple, got["even"].collect())) == even
    assert {r[0] for r in got["loop"].collect()} == {x for x, y in even if x == y}
    assert set(map(tuple, got["from_one"].collect())) == {(y, 7) for x, y in odd if x == 1}
    assert {r["v"] for r in got["mark"].collect()} == reached and got["none"].count() == 0
    with pytest.raises(ValueError, match="y"):
        rules.rule(("p", "y"), ("edge", "x", "x"))


def test_variadic_calls(spark):
    """f(a, ...) called with four arguments: the first has its parameter, the others share the next place, and all reach it."""
    shape = "fn bigint, pos int, opcode string, dst bigint, operands array<bigint>, nargs int, callee bigint, is_variadic boolean, n_params int"
    calls = [(1, 0, "call", 50, [10, 11, 12, 13], 4, 2, True, 1), (1, 1, "call", 51, [10, 11], 2, 3, False, 2), (1, 2, "call", 52, [], 0, 2, True, 1), (1, 3, "call", 53, [None, 14], 2, 2, True, 1)]
    e = lifting.lift(spark.createDataFrame(calls, shape))
    assert rows(e, "rel", "dst", "src", "idx") == sorted([("ArgumentSupply", 50, 10, 0), ("ArgumentSupply", 50, 11, 1), ("ArgumentSupply", 50, 12, 1), ("ArgumentSupply", 50, 13, 1), ("ArgumentSupply", 51, 10, 0), ("ArgumentSupply", 51, 11, 1), ("ArgumentSupply", 53, 14, 1), ("Call", 50, 2, 2), ("Call", 51, 3, 2), ("Call", 52, 2, 1), ("Call", 53, 2, 2)], key=repr)
    functions = spark.createDataFrame([(2, 1, 90, 91, 92)], "fn bigint, n_params int, list bigint, area bigint, rest bigint")
    params = lifting.variadic(functions).where("rel = 'ArgumentDefinition'").select(F.col("src").alias("fn"), F.col("idx").alias("arg_no"), F.col("dst").alias("value"))
    supply = e.where("rel = 'ArgumentSupply'").select(F.col("dst").alias("site"), F.col("idx").alias("arg_no"), F.col("src").alias("value"))
    none = spark.createDataFrame([], "dst bigint, src bigint")
    alloc = spark.createDataFrame([(x, 1000 + x) for x in (10, 11, 12, 13, 14)], "node bigint, obj bigint")
    pts = andersen.points_to(spark, alloc, none, none, none, spark.createDataFrame([(2,), (3,)], "node bigint"), e.where("rel = 'Call'").select(F.col("dst").alias("site"), F.col("src").alias("callee")), supply, params)
    assert {o for n, o in rows(pts, "node", "obj") if n == 92} == {1011, 1012, 1013, 1014}


def test_strategies(spark, tmp_path):
    """One program by all strategies: main calls f directly and g through a pointer that f's address never reaches."""
    site, kind = "main:1", "string"
    edges = spark.createDataFrame([("Assign", "main", "main:2", "g", None), ("Call", "main", site, "f", None), ("Call", "main", "main:3", "main:2", None)], "rel string, fn string, dst string, src string, idx bigint")
    symbols = [("main",), ("f",), ("g",), ("h",)]
    enclosing = spark.createDataFrame([("main", f"main:{i}") for i in (1, 2, 3)], "fn string, local string")
    seeds = spark.createDataFrame([("main",)], f"node {kind}")
    calls = spark.createDataFrame([(site, "f"), ("main:3", "main:2")], "site string, callee string")
    names = spark.createDataFrame([(s, s) for (s,) in symbols], "node string, name string")
    facts = {"edges": edges.where("rel <> 'Call'").select("rel", "dst", "src"), "calls": calls, "enclosing": enclosing, "symbols": names.select("node"), "names": names, "seeds": seeds}
    two = lambda c: spark.createDataFrame([], f"fn string, {c}")
    side = {"IsSymbol": spark.createDataFrame([("main", s) for (s,) in symbols], "fn string, v string"), "IsAlloca": two("v string"), "Starred": two("starred string, node string"), "ValueName": two("core string, value string")}
    pair = spark.createDataFrame([], "dst string, src string")
    points = {"alloc": spark.createDataFrame([], "node string, obj string"), "assign": facts["edges"].select("dst", "src"), "load": pair, "store": pair, "funcs": names.select("node"), "calls": calls}
    reached = {"main", "f", "g"}
    for strategy in (strategies.simple(facts), strategies.summaries(edges, side, enclosing, seeds), strategies.pointers(points, enclosing, seeds)):
        found = strategy()
        assert {r["node"] for r in found.reachable.collect()} == reached
        assert {(r["site"], r["callee"]) for r in found.callgraph.collect()} == {(site, "f"), ("main:3", "g")}
    number = spark.createDataFrame([("0x0000000000000010",), ("10:0x1",), ("main",), ("ffffffffffffffff",)], "node string")
    strategies.save(strategies.Reached(number, found.callgraph), str(tmp_path / "r"), str(tmp_path / "c"))
    again = strategies.saved(spark, str(tmp_path / "r"), str(tmp_path / "c"))()
    assert {int(r["node"]) for r in again.reachable.collect()} == {16, (1 << 64) - 1}
    assert set(map(tuple, again.callgraph.collect())) == set(map(tuple, found.callgraph.collect()))
