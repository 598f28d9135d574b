"""A corpus pipeline: language, near copies, benchmark passages, mixing, token ids.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before has kept; its result is written as
Parquet and read again as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strataguild.llm import decontaminate, langid, mixing, simhash, tokens
from strataguild.llm.common import checkpoint_folder, read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the others, such as those without letters, go."""
    return langid.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return simhash.drop_near_copies(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose mixing rate rounds to one or more, with no weight for the toxic domains; no new copies."""
    return mixing.apply_mix(docs, read(spark, sf_dir, "labels"), unwanted=("good_toxic", "poor_toxic"), most=1)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents, written to coded files, and what the files say of each document."""
    return tokens.store_ids(docs)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontaminate", clean_of_benchmark),
    ("mix", mix),
    ("token_ids", token_ids),
]

# Hashes, trained models and a tokenizer are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
