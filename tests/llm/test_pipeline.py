"""The pipeline's stages, each on what the one before kept."""

import random

import public_tokenizers
import pytest
import tiktoken

from sparkreach.llm import bpe

from . import helpers
from .test_operators import PATH, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, d = random.Random(11), str(tmp_path_factory.mktemp("tables"))
    good = [prose(rng, rng.randint(60, 120)) for _ in range(60)]
    item = prose(rng, 30, 10**6)
    texts = [*good, *good[:5], *(g + " end" for g in good[5:10]), *(f"{g[:200]} {item}" for g in good[10:14]), *(f"{g} me@mail.example.com" for g in good[14:18]), *("#@!~" * 80 for _ in range(6))]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int("#" not in t), 0) for i, t in enumerate(texts)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, dict(enumerate(texts)), item


def test_stages(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    d, texts, item = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, d)
        if k < 4:
            assert docs.columns == columns
            seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    quality, near, clean, private = seen
    assert all("#@!~" not in t for t in quality.values()) and len(quality) >= 0.95 * sum("#" not in t for t in texts.values())
    assert set(near) == {i for i, (_, c) in helpers.components(list(quality.items())).items() if i == c}
    bad = {i for i, e in zip(near, helpers.contamination(near.values(), [(1, item)])) if e[4]}
    assert bad and set(clean) == set(near) - bad
    assert set(private) == set(clean) and not any("@" in t for t in private.values())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(PATH), special_tokens={})
    assert {r["doc_id"]: r["n_tokens"] for r in docs.collect()} == {i: len(own.encode_ordinary(t)) for i, t in private.items()}


def test_hard_cases(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows, long texts, several languages and columns that clash; then empty tables throughout."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng, d = random.Random(13), str(tmp_path)
    good = [prose(rng, rng.randint(60, 120)) for _ in range(40)]
    long = prose(rng, 30_000, 3000)
    item = prose(rng, 30, 10**6)
    rows = [(i, t, ("en", "de", None)[i % 3], None if i % 5 == 0 else "s", None if i % 7 == 0 else len(t)) for i, t in enumerate(good)]
    rows += [(100, None, "en", "s", 0), (101, "", "en", "s", 0), (102, " \n", None, None, None), rows[1], rows[1], (None, good[2], "en", "s", 1), (None, good[9] + " " + good[11], "en", "s", 1), (103, long, "de", "s", len(long)), (104, f"{good[3]} {item}", "en", None, 1)]
    shape = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid bigint, block string, kept boolean, _in0 string, hits int"
    docs = spark.createDataFrame([(*r, 1, "b", True, "x", 2) for r in rows], shape).repartition(3)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (None, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([*((i, 1, None) for i in range(0, 40)), (None, 1, 1), (5, None, 0), (999, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    step, seen = docs, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        step = stage(spark, step, d)
        if k < 4:
            assert step.columns == docs.columns
            seen.append(step.select("doc_id", "text").collect())
    quality, near, clean, private = seen
    assert {r["doc_id"] for r in quality}.isdisjoint({100, 101, 102}) and 103 in {r["doc_id"] for r in quality}
    assert sum(r["doc_id"] == 1 for r in quality) == 3 and sum(r["doc_id"] == 1 for r in near) == 1
    assert len(near) == len({r["text"] for r in near})
    named = {r["text"] for r in quality if r["doc_id"] is not None}
    assert {r["text"] for r in near if r["doc_id"] is None} == {r["text"] for r in quality if r["doc_id"] is None} - named != set()
    assert 104 not in {r["doc_id"] for r in clean} and len(clean) >= len(near) - 1 and len(private) == len(clean)
    assert next(r["text"] for r in private if r["doc_id"] == 103) == long and step.count() == len(private)
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{d}/{name}.parquet").where("false").write.parquet(f"{d}/empty/{name}.parquet")
    empty = f"{d}/empty"
    step = spark.read.parquet(f"{empty}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        step = stage(spark, step, empty)
        assert step.count() == 0 and (k == 4 or step.columns == docs.columns)
