"""Linking: rounds of bounded work, components by contraction; sets and words without a hash of all of them."""

import random

import numpy as np
import public_tokenizers
import pytest
import regex

from sparkreach.llm import blocks, bpe, ngram_join

from .test_operators import prose


@pytest.fixture
def tables(monkeypatch):
    """Names and rows of the tables that ngram_join writes."""
    seen, write = [], ngram_join.written

    def noted(df, name, *more, **options):
        table = write(df, name, *more, **options)
        seen.append((name, table.count()))
        return table

    monkeypatch.setattr(ngram_join, "written", noted)
    return seen


def lowest(links):
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def graphs():
    rng = random.Random(5)
    some = rng.sample(range(10**6), 200)
    yield [(some[i], some[i + 1]) for i in range(199)]  # a path in no order
    yield [(10**7, x) for x in some]  # stars around the largest and the smallest
    yield [(-1, x) for x in some]
    yield [(i, i + 1) for i in range(150)] + [(7, 7), (8, 7)]
    yield [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]


@pytest.mark.parametrize("links", list(graphs()))
def test_components(spark, tables, links):
    """Edges are drawn anew between the vertices that stay; all links are read in the first round alone."""
    found = {r["v"]: r["c"] for r in ngram_join.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == lowest([x for x in links if x[0] != x[1]])
    left = [n for name, n in tables if name == "edges"]
    assert left[-1] == 0 and all(2 * b <= max(a, 8) for a, b in zip(left, left[2:])) and [name for name, _ in tables].count("labels") == 1


def test_no_components(spark):
    none = spark.createDataFrame([(1, 1)], "a bigint, b bigint")
    assert ngram_join.components(none).count() == 0 and ngram_join.components(none.where("false")).columns == ["v", "c"]


def test_rounds_of_a_large_group(spark, tables):
    """Near copies that share hundreds of keys vote with LEADS of them and are verified against CENTRES documents."""
    rng = random.Random(6)
    words, rows = [f"w{i}" for i in range(150)], []
    for i in range(300):
        w = list(words)
        w[rng.randrange(len(w))] = f"e{i}"
        rows.append((i, " ".join(w)))
    found = ngram_join.classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert {r["component_id"] for r in found} == {0}
    written = dict(tables)
    assert written["entries"] > 60 * 300 and written["leads"] <= ngram_join.LEADS * 300
    assert all(n <= ngram_join.CENTRES * 300 for name, n in tables if name == "pairs")


def test_sets_are_sorted_once(monkeypatch):
    """Blocks find their counts without np.unique, which hashes all numbers before it sorts them."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(1, 80), 60) for _ in range(40)] + ["", "one"]
    data = [t.encode() for t in texts]
    sets = [ngram_join.shingles(t) for t in data]
    every, counts = np.unique(np.concatenate(sets), return_counts=True)
    expected = []
    for s in sets:
        df = counts[np.searchsorted(every, s)].astype(np.uint8)
        order = np.lexsort((s, df))
        expected.append(ngram_join.keys(s[order], df[order], 1) if len(s) else [])
    row = {"rids": range(len(texts)), "doc_ids": range(len(texts)), "marks": texts, "lengths": list(map(len, data)), "data": blocks.squeeze(b"".join(data))}

    def refuse(*_, **__):
        raise AssertionError("np.unique")

    monkeypatch.setattr(np, "unique", refuse)
    found = ngram_join.candidates(row, counts.astype(np.uint8), {})
    assert any(expected) and dict(zip(found["rid"], found["keys"], strict=True)) == {i: k for i, k in enumerate(expected) if k}
    assert ngram_join.distinct(np.array([3, 1, 3, 2, 1], np.uint64)).tolist() == [1, 2, 3] and not len(ngram_join.distinct(np.zeros(0, np.uint64)))


def test_ascii_texts_are_split_alike():
    """ASCII texts go another way to the same words; patterns with more than simple classes do not."""
    pattern = public_tokenizers.PATTERN
    plain, every, rng = bpe.ascii_only(pattern), regex.compile(pattern).findall, random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice([*map(chr, range(128)), " ", " ", "  ", "'ll", "\n"]) for _ in range(30))
        assert plain(text) == every(text) == bpe.splitter(pattern)(text)
    for other in (r"[^\r\n\p{L}]?+\p{L}+", r"(?i:'s)|\p{L}+", r"\p{Lu}+", r"\w+", r"[\p{L}--[a-z]]+"):
        assert bpe.ascii_only(other) is None and bpe.splitter(other)("Ab c's d") == regex.compile(other).findall("Ab c's d")
    block = bpe.Block(0)
    block.add(1, "a b a", bpe.splitter(pattern))
    block.add(2, "b a c", bpe.splitter(pattern))
    assert list(block.words) == ["a", " b", " a", "b", " c"] and [t.tolist() for t in block.texts] == [[0, 1, 2], [3, 2, 4]]
