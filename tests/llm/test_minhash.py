"""Min-max hashing: signatures, and components against brute force."""

import random

import numpy as np
import pytest

from sparkreach.llm import blocks, minhash, ngram_join

from . import helpers
from .test_operators import by_id, corpus, docs, empty, prose  # noqa: F401


def brute(rows):
    return {i: (n, c, i == c) for i, (n, c) in helpers.components(rows, size=5).items()}


def test_classes(docs, empty):  # noqa: F811
    assert by_id(minhash.report(docs), "n_shingles", "component_id", "kept") == brute(corpus())
    assert minhash.report(empty).count() == 0
    left = minhash.one_of_each(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, (_, _, k) in brute(corpus()).items() if k}


def test_signature_estimates_similarity():
    """Half as many hashes as values, the share of equal values without bias, the variance no larger than of independent ones."""
    rng = np.random.default_rng(3)
    for both in (100, 400, 700):
        shares = []
        for _ in range(120):
            x = rng.integers(0, 1 << 63, 1600 - both, dtype=np.uint64)
            half = (1600 - 2 * both) // 2
            a, b = x[: both + half], x[len(x) - both - half :] if both else x[half:]
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            shares.append(np.mean(minhash.signature(a) == minhash.signature(b)) - true)
        assert abs(np.mean(shares)) < 0.012
        assert np.var(shares) < 1.5 * true * (1 - true) / (2 * minhash.PERMUTATIONS)
    assert len(minhash.signature(x)) == 2 * minhash.PERMUTATIONS
    assert (minhash.signature(x) == minhash.signature(np.concatenate((x, x[:10])))).all()


def test_bands_catch_the_limit():
    """At a similarity of 0.85 the chance to share no key is below one in ten million."""
    n = 2 * minhash.PERMUTATIONS // minhash.ROWS
    assert (1 - 0.85**minhash.ROWS) ** n < 1e-7 and len(minhash.bands(minhash.signature(np.arange(9, dtype=np.uint64)))) == n


@pytest.mark.parametrize("seed", [1, 2])
def test_groups(spark, seed, monkeypatch):
    """Groups of near copies and chains of links of all sizes, texts longer than a block, small cells, passages that many share."""
    monkeypatch.setattr(ngram_join, "CELL", 3)
    whole = blocks.pack
    monkeypatch.setattr(minhash, "pack", lambda d, f: whole(d, f, 4000))
    rng, rows = random.Random(seed), []
    passage = prose(rng, 60, 5000)
    for g in range(8):
        w = [f"g{g}x{k}" for k in range(rng.choice([8, 12, 30, 64, 150, 2000]))]
        for _ in range(20):
            w = list(w)
            if rng.random() < 0.8:
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(w) if rng.random() < 0.7 else " ".join(w[: int(len(w) * 0.93)]))
    rows += [passage + " " + prose(rng, n, 10**6) for n in (4, 5, 6, 7, 8, 9, 40) for _ in range(6)]
    rng.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(4)
    assert by_id(minhash.report(df), "n_shingles", "component_id", "kept") == brute(list(enumerate(rows)))


def test_rows_and_ids(spark):
    """Repeated rows, null ids, one id with two texts, ids that are strings."""
    x, y = "a b c d e f g", "one two three four five six"
    rows = [("d3", x), ("d5", x), ("d5", y), (None, x), (None, "n n n u l l l"), ("d9", None), ("d10", "")]
    found = sorted(map(tuple, minhash.report(spark.createDataFrame(rows, "doc_id string, text string")).collect()), key=repr)
    assert found == sorted([("d3", 3, "d3", True), ("d5", 3, "d3", False), ("d5", 2, "d5", True), (None, 3, "d3", False), (None, 3, None, True), ("d9", 0, "d9", True), ("d10", 0, "d10", True)], key=repr)
