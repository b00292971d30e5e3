"""A training corpus from ``documents``: quality rules, line dedup, near-dedup, decontamination, mixing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tenure.llm import line_dedup, line_frequency, mixing, near_dedup, retrieval
from tenure.llm.common import discard, stored, written
from tenure.session import prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of operator 6, without lines common on their host."""
    prepare(spark)
    return line_frequency.filtered(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5 over the corpus: a line that ten documents repeat stays where it occurs first."""
    prepare(spark)
    return line_dedup.deduplicated(docs, min_docs=10)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 on five words and 0.8: the first document of each group stays."""
    prepare(spark)
    return near_dedup.first_of_each(docs, size=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark passage go."""
    prepare(spark)
    return retrieval.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the documents the mix uses, with words taken and training position, in order of the position."""
    prepare(spark)
    return mixing.sequence(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again.

    Once a stage's result is written, the tables that the stage made on the way are deleted.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        before = written(spark)
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            made = written(spark)[len(before):]
            docs = stored(docs, name)
            discard(spark, made)
    return docs
