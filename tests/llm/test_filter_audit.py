"""The audit against plain Python; the byte pass against regular expressions, its hash table with equal hashes."""

import random
import re
from itertools import permutations

import numpy as np

from sparkreach.llm import filter_audit

from .test_operators import corpus, docs, empty, prose  # noqa: F401

NUMBERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def facts(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    return len(w), len(set(w)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))


def audit(rows, labels):
    """rows: (doc_id, lang, text)."""
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))
    told = {}
    for i, lang, t in rows:
        n, new, caps, points, symbols = facts(t or "")
        later = (t or "") in first and (i is None or i > first[t or ""])
        fails = {c for c, f in zip("ABCDE", (n < 200, 100 * new < 50 * n, 100 * caps > 3 * points, symbols > 0, later)) if f}
        told.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out = {}
    for part, x in told.items():
        shares = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for k, c in enumerate(order):
                gone = set(order[:k])
                here = [(g, b) for f, g, b in x if c in f and not f & gone]
                shares[c] += len(here)
                out[part, order, k + 1] = [sum(not f & (gone | {c}) for f, _, _ in x), len(here), sum(c in f and bool(f & gone) for f, _, _ in x), sum(f == {c} for f, _, _ in x), sum(g for g, _ in here), sum(b for _, b in here)]
        for order in map("".join, permutations("ABCDE")):
            for k, c in enumerate(order):
                out[part, order, k + 1].append(shares[c])
    return out


def found(df, labels):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in NUMBERS] for r in filter_audit.report(df, labels).collect()}


def sample():
    rng, rows = random.Random(4), []
    for i in range(160):
        t = prose(rng, rng.randint(150, 320), rng.choice([30, 2000]))
        if rng.random() < 0.3:
            t = t.upper()
        if rng.random() < 0.3:
            t += " #tag|"
        rows.append((i, rng.choice(["en", "de", "zz", "", None]), t))
    rows += [(1000 + k, rng.choice(["en", "de"]), rows[k % 9][2]) for k in range(60)]
    rows += [(5, "en", None), (3, "de", ""), (None, "en", ""), (None, "en", rows[0][2]), (None, "en", "own"), (None, "de", "own"), rows[7], rows[7], (-4, "fr", rows[3][2])]
    labels = [(i, int(rng.random() < 0.6), int(rng.random() < 0.2)) for i in range(0, 1000, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (1001, None, None)]
    return rows, labels


def test_audit(spark):
    rows, labels = sample()
    df = spark.createDataFrame([(*r, "m", 1) for r in rows], "doc_id bigint, lang string, text string, mask string, n int").repartition(5)
    known = spark.createDataFrame([(*x, "g") for x in labels], "doc_id bigint, quality int, toxic int, good string")
    assert found(df, known) == audit(rows, labels)
    assert len(found(df, known)) == 5 * 600
    assert found(df, known.where("false")) == audit(rows, [])
    assert found(df.where("false"), known) == {}
    names = df.selectExpr("concat('d', doc_id) AS doc_id", "lang", "text")
    assert set(found(names, known.selectExpr("concat('d', doc_id) AS doc_id", "quality", "toxic"))) == set(found(df, known))


def test_counts_of_texts(spark, docs):  # noqa: F811
    """Every count of the pass, in chunks of one text and of several."""
    expected = {i: facts(t or "") for i, t in corpus()}
    for size in (1, 3000, 4 << 20):
        assert {r["doc_id"]: tuple(r[c] for c in filter_audit.COUNTS) for r in filter_audit.scan(docs, size).collect()} == expected


def test_one_long_word():
    text = ("x" * 300_000 + " ") * 3 + "y" * 300_001
    data = np.frombuffer(text.encode(), np.uint8)
    assert [int(x[0]) for x in filter_audit.counts(data, np.array([0, len(data)]))] == list(facts(text))


def test_table_verifies(monkeypatch):
    """Spans whose hashes are all equal are still told apart by owner, length and bytes."""
    monkeypatch.setattr(filter_audit, "A", np.uint64(0))
    monkeypatch.setattr(filter_audit, "B", np.uint64(0))
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 19))) for _ in range(60)) for _ in range(4)] + ["", " ", "é é é"]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    got = filter_audit.counts(np.frombuffer(b"".join(raw), np.uint8), bounds)
    assert list(zip(*(x.tolist() for x in got))) == [facts(t) for t in texts]
