"""One query per operator over the given tables, each with its SQL check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; timestamps leave it without a zone, as in the files."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(spark, sf_dir)
            zoned = {
                f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields if isinstance(f.dataType, TimestampType)
            }
            return df.withColumns(zoned) if zoned else df

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from tenure.plans import (  # noqa: F401
        effect_queries,
        history_queries,
        lease_queries,
        metric_queries,
        ownership_queries,
        step_queries,
        stream_queries,
    )
