"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's docs.

Each stage calls one operator of sparkreach.llm on all that the stage before kept, and its decisions take effect:
documents that the quality classifier rejects go, one document of each near-duplicate component stays, contaminated
documents go, personal data are replaced in the text, and what is left is encoded and decoded. All but the last return
the columns of documents, under their names and whatever these are.

Cases: documents without text, or with an empty one, have no perplexity and go in the first stage; a null lang is judged
by the threshold of all; of repeated rows and copies the one of the smallest doc_id stays (a null id last, of equal rows
the first); a stage that is given an empty table returns one, with its columns; without labels nothing that has text is
rejected; without benchmark items nothing is contaminated; texts are read whole in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkreach.llm import bpe, decontamination, kneser_ney, ngram_join, pii
from sparkreach.llm.common import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kneser_ney.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.report(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: The classifier's and the sanitiser's models, and the merges, are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name, "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
