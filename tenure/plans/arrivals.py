"""The given tables as files that arrive part by part, and streams run over them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from tenure.session import scratch_path
from tenure.streaming.run import start_batches, start_to_table


class Parts:
    """Parts of ``df`` by equal ranges of ``order``; each step of an iteration lets the next one arrive in ``path``.

    A part is written by all executors and stays whole in one batch as long as the query
    runs once per step.
    """

    def __init__(self, df: DataFrame, name: str, order: str | None = None, parts: int = 1):
        self.df, self.order, self.parts = df, order, parts
        self.path = scratch_path(df.sparkSession, name)
        df.where(F.lit(False)).write.parquet(self.path)

    def __iter__(self) -> Iterator[int]:
        df, parts = self.df, self.parts
        slices = F.lit(0)
        if parts > 1:
            place = F.unix_micros(self.order) if isinstance(df.schema[self.order].dataType, TimestampType) else F.col(self.order)
            low, high = df.agg(F.min(place), F.max(place)).first()
            if low is not None:
                slices = F.least(F.floor((place - low) * parts / max(high - low, 1)), F.lit(parts - 1))
        for part in range(parts):
            df.where(slices == part).write.mode("append").parquet(self.path)
            yield part

    def read(self, spark: SparkSession) -> DataFrame:
        """What has arrived so far."""
        return spark.read.schema(self.df.schema).parquet(self.path)


def arriving(df: DataFrame, name: str, order: str | None = None, parts: int = 1) -> tuple[DataFrame, Parts]:
    """``df`` as a stream of files, and the parts whose iteration lets them arrive."""
    steps = Parts(df, name, order, parts)
    return df.sparkSession.readStream.schema(df.schema).parquet(steps.path), steps


def drain(stream: DataFrame, name: str, steps: Iterable[int] = (0,)) -> DataFrame:
    """Run a stream over what its source has, once per step, and read the result back."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    for _step in steps:
        start_to_table(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def drain_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], name: str, steps: Iterable[int] = (0,)) -> None:
    base = scratch_path(stream.sparkSession, name)
    for _step in steps:
        start_batches(stream, each, f"{base}/checkpoint").awaitTermination()
