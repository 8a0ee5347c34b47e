"""Manifests against a tree in plain Python."""

import hashlib
import random
import zlib

import pytest

from sparkreach.llm import merkle

from .test_operators import by_id, corpus, docs, empty  # noqa: F401

COLUMNS = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """The root, and for each node the (left, right) siblings of each level."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            start = p - p % 3
            steps[k].append(("".join(nodes[start:p]), "".join(nodes[p + 1 : start + 3])))
        nodes, at = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [p // 3 for p in at]
    return nodes[0], steps


def manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text). One tuple of the query's columns for each."""
    leaf = lambda r, t: h(*map(field, (*r[:4], t)))
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r, leaf(r, r[4])))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted(x, key=lambda y: (y[0][0] is not None, y[0][0] or 0, y[1])) for s, x in by_source.items()}
    inner = {s: tree([x[1] for x in order[s]]) for s in names}
    root, outer = tree([inner[s][0] for s in names])
    out = []
    for s, above in zip(names, outer):
        for (r, own), steps in zip(order[s], inner[s][1]):
            steps = steps + above
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            got = leaf(r, r[4].replace("\n", "")) if changed else own
            for a, z in steps:
                got = h(a, got, z)
            out.append((r[0], own, inner[s][0], root, h(*(a + z for a, z in steps)), got, got == root))
    return sorted(out, key=repr)


def found(df, levels=merkle.LEVELS):
    return sorted((tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in merkle.report(df, levels).collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(spark, levels):
    """Several tiers in both trees, sources of 1 to 200 rows, nulls, ties, repeated rows, long texts, clashing columns."""
    rng = random.Random(levels)
    sources = [None, "", "a", "é", "\U0001f600", "￮", *(f"s{i}" for i in range(9))]
    rows = [(i, rng.choice(sources) if i % 3 else "hot", rng.choice(["en", None]), rng.randrange(99), f"t{i}\nü\n" * rng.randint(0, 3)) for i in range(420)]
    rows += [(7, "only", None, None, None), (None, "s1", "en", 1, "x\ny"), (None, "s1", "en", 1, "x\ny"), rows[5], rows[5], (rows[5][0], rows[5][1], "xx", 5, "other"), (10**17, "s2", None, 2, "long\n" * 200_000)]
    df = spark.createDataFrame([(*r, "t", 3, "p") for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, place int, leaf string").repartition(5)
    assert found(df, levels) == manifest(rows)


def test_small(spark, docs, empty):  # noqa: F811
    assert merkle.report(empty).count() == 0
    one = [(4, "s", "en", 2, "a\nb")]
    df = spark.createDataFrame(one, "doc_id int, source string, lang string, n_chars bigint, text string")
    assert found(df) == manifest(one) and found(df)[0][1] == found(df)[0][3]
    assert merkle.report(df).schema["doc_id"].dataType.simpleString() == "int"
    rows = [(i, "s", ("en", "de", None)[i % 3], 0, t) for i, t in corpus()]
    assert found(docs) == manifest(rows)
    names = spark.createDataFrame([("b", "s", None, 1, "x\n"), ("a", "s", None, 1, "y\n"), (None, "s", None, 1, "z")], "doc_id string, source string, lang string, n_chars bigint, text string")
    assert {r["doc_id"] for r in merkle.report(names).collect()} == {"a", "b", None}


def test_proofs_verify(spark):
    """The operator's own output: the siblings of each level fold a leaf to the root, and any other text to another."""
    from pyspark.sql import functions as F

    rows = [(i, f"s{i % 2}", "en", 3, f"text {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    for r in merkle.prove(df, F.concat("text", F.lit("!"))).collect():
        assert merkle.folded(r["leaf"], r["left"], r["right"]) == r["root"] != r["folded_root"]
    assert by_id(merkle.prove(df), "folded_root") == by_id(merkle.prove(df), "root")
