"""A training corpus from ``documents``: language, exact and near duplicates, benchmark leaks, packing.

Each stage takes what the one before it kept and returns the columns of ``documents``; the last returns the pieces of
packed sequences.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tagloom.llm.decontaminate import drop_leaks
from tagloom.llm.exact_dedup import keep_first
from tagloom.llm.lang_id import drop_unidentified
from tagloom.llm.minhash import keep_one_of_each
from tagloom.llm.packing import pack
from tagloom.llm.shared import bounded_batches, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    """Stages follow each other in the same executors and Python workers, so each asks for small batches."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_bounded
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter or far from every learned language go."""
    return drop_unidentified(docs)


@_bounded
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return keep_first(docs)


@_bounded
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 on five-word shingles the one with the smallest id."""
    return keep_one_of_each(docs, size=5, percent=80)


@_bounded
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_bounded
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminate), ("packing", packing)]

#: SQL has neither the centroids nor differencing; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
