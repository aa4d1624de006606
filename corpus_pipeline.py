"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes all that its predecessor kept. The first four return the columns of documents; the last adds token
ids. Documents go that are toxic, that repeat a document nearly or that hold a benchmark item; passages go that stand
in an earlier document too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import benchmarks, near_copies, sentencepieces, substrings, toxicity
from quillon.shipping import ship
from quillon.sources import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go."""
    return toxicity.reject_toxic(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, Jaccard 0.8) stays, that with the smallest id."""
    ship(spark)
    return near_copies.without_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages go that stand in an earlier document, or earlier in their own; every document stays."""
    ship(spark)
    return substrings.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return benchmarks.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids."""
    ship(spark)
    return sentencepieces.with_token_ids(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_documents),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("sentencepiece", token_ids),
]

#: Automata, LSH, components and token ids are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is a written table that the next stage reads."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
