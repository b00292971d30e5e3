"""Helpers that several operators of this package share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.session import scratch_path

# What counts as white space, what as a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_ID = -(2**63)


def text_of(column: str = "text") -> Column:
    """The text, with null as an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def doc_key() -> list[Column]:
    """What tells documents apart: doc_id (null has a value of its own) and the text's hash."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_of()).alias("text_key")]


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(column, UPPER, UPPER.lower())


def words(column: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(0))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new place in the shared folder and go on from the files: short lineage, computed once."""
    path = scratch_path(df.sparkSession, name)
    _WRITTEN.setdefault(id(df.sparkSession._jsparkSession), []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITTEN: dict[int, list[str]] = {}


def written(spark: SparkSession) -> list[str]:
    """Places of the tables that ``stored`` has written for this session, in order."""
    return list(_WRITTEN.get(id(spark._jsparkSession), []))


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that no result needs any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _WRITTEN[id(spark._jsparkSession)] = [p for p in written(spark) if p not in set(paths)]


def clear(spark: SparkSession) -> int:
    """Delete what ``stored`` has written for this session, once no result needs it any more; the number of tables."""
    paths = written(spark)
    discard(spark, paths)
    return len(paths)


def ranked(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """Distinct rows with their place in the order of ``key`` (null last), from 0, without one task that sorts all."""
    last = df.withColumn("_null", F.col(key).isNull().cast("int"))
    count = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = stored(
        last.repartitionByRange(count, "_null", key).sortWithinPartitions("_null", key)
        .withColumn("_id", F.monotonically_increasing_id()),
        name,
    )
    before, starts = 0, []
    for row in rows.groupBy(F.shiftright("_id", 33).alias("part")).count().orderBy("part").collect():  # one per partition
        starts.append((row["part"], before))
        before += row["count"]
    if not starts:
        return rows.select(*df.columns, F.lit(0).cast("long").alias(name))
    offsets = F.create_map(*[F.lit(x).cast("long") for pair in starts for x in pair])
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.element_at(offsets, F.shiftright("_id", 33))
    return rows.select(*df.columns, place.alias(name))


def row_keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_file`` and ``_index``, which tell every row from every other, equal ones too.

    They are a row's place in the files it is read from, so they are the same whenever it is
    read. Rows that do not come straight from files are written to the shared folder first.
    """
    try:
        return docs.withColumns({"_file": F.xxhash64("_metadata.file_path"), "_index": F.col("_metadata.row_index")})
    except AnalysisException:
        return row_keyed(stored(docs, "rows"))


def rest(docs: DataFrame, *but: str) -> Column:
    """All columns but those as one struct, ``_rest``, so that their names meet no others."""
    held = [c for c in docs.columns if c not in but]
    return F.struct(*[F.col(f"`{c}`") for c in held] or [F.lit(None).alias("_")]).alias("_rest")


def restored(df: DataFrame, docs: DataFrame, **made: Column) -> DataFrame:
    """The columns of ``docs``, in their types: from ``made``, or out of ``_rest``."""
    out = [(made[c] if c in made else F.col("_rest").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns]
    return df.select(*out)
