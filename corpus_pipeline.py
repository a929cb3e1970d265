"""The corpus pipeline: documents through the operators of ``tablewright.llm``, one Parquet table per stage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import decontaminate, jaccard, language, queries, toxicity
from tablewright.llm.common import shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Near copies share this part, in percent, of their shingles of so many words.
COPY_WORDS, COPY_PERCENT = 5, 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored as toxic go."""
    return toxicity.keep_clean(docs, queries.toxicity_model(spark, sf_dir))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those of which no language has half the letters, go."""
    return language.keep_known(docs, queries.language_model(spark, sf_dir))


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return jaccard.keep_one(docs, COPY_WORDS, COPY_PERCENT)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents with nothing else go."""
    return decontaminate.cut_spans(docs, decontaminate.windows(table(spark, sf_dir, "benchmark")))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return queries.token_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("copies", copies_stage),
    ("benchmark", benchmark_stage),
    ("tokens", tokens_stage),
]

# Learned scores cannot be said in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for step, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{step}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
