"""First-wins effects on a stream, decided by the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.operators.effects import apply_effects, new_store_rows
from tenure.sources.sinks import append_rows

_STORE = "idempotency_key STRING, effect_type STRING, request STRING, result STRING, created_at TIMESTAMP"


class EffectLog:
    """Decide each batch of requests against what is stored, and store what it applies.

    For ``foreachBatch``. Two folders below ``path``, each written one partition per batch,
    so a batch run again replaces what it wrote: outcomes (every request, invalid ones too)
    and store. Batches are taken in order, rows within one by (ts, seq), so the outcomes are
    those of ``apply_effects`` over all requests if none arrives before an older one.
    ``initial`` are effects stored earlier.
    """

    def __init__(self, path: str, initial: DataFrame | None = None):
        self.path = path
        self.initial = initial

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        append_rows(apply_effects(batch, self.store(spark, batch_id)), f"{self.path}/outcomes", batch_id)
        decided = spark.read.parquet(f"{self.path}/outcomes").where(F.col("batch_id") == batch_id)
        append_rows(new_store_rows(decided), f"{self.path}/store", batch_id)

    def store(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Effects stored before the batch, or all of them."""
        rows = spark.createDataFrame([], _STORE)
        if self.initial is not None:
            rows = self.initial.select(rows.columns).unionByName(rows)
        if before == 0:
            return rows
        written = spark.read.parquet(f"{self.path}/store")
        if before is not None:
            written = written.where(F.col("batch_id") < before)
        return rows.unionByName(written.select(rows.columns))

    def outcomes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/outcomes").drop("batch_id")
