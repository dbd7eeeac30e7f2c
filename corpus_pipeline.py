"""Cleaning of ``documents`` for training: five stages, each written as Parquet and reread as the input of the next.

1. ``toxicity``: documents that the learned model scores at ``toxicity.TOXIC_FROM`` or more go.
2. ``near_dedup``: of each group of near duplicates (five words a shingle, similarity 0.8 or
   more) the document with the least id stays; documents without words stay, each
   row of them.  Rows with words that repeat an id stay only once, the one with the least
   text; rows without an id stay once a group.
3. ``decontamination``: documents with a window of ten words of a benchmark item go.
4. ``secrets``: secrets are replaced by a mark, and ``n_chars`` follows the text.
5. ``bpe``: the texts as token ids, with the digests of the ids and of the decoded text.

All but the last return the columns of ``documents``.  SQL cannot express the first
stage (a learned model), so ``ORACLE_SQL`` is None and tests hold each stage against a
brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandwork.llm import bpe, decontamination, near_dedup, secrets, toxicity
from strandwork.llm.queries import BYTE_BPE, toxic_from
from strandwork.llm.texts import table
from strandwork.session import shared_folder

ORACLE_SQL = None
NEAR = near_dedup.Rule(size=5, percent=80)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), toxic_from))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.representatives(docs, NEAR)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, BYTE_BPE, ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
