"""The cache of dense vectors: lines of JSON, {"key": ..., "values": [...]}."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.index import embed_missing, missing_batches, unit
from quarry.sources.shared import exists, shared_folder

SCHEMA = "key string, values array<double>"


def write_cache(rows: DataFrame, path: str | None = None) -> tuple[SparkSession, str]:
    """Replaces the cache at path (a new shared folder if none) by rows (key, values)."""
    path = path or shared_folder(rows.sparkSession)
    rows.select("key", "values").write.mode("overwrite").json(path)
    return rows.sparkSession, path


def fill_cache(keyed: DataFrame, path: str, embed: Callable[[list[str]], list[list[float]]], size: int = 24, most: int = 0) -> DataFrame:
    """The cache at path with the vectors that keyed (key, dense_text) lacks there: those alone are made and appended.

    A run that fails halfway has appended what its tasks ended, and the next one makes the rest. Texts that embed to
    nothing are asked again each time. most: only so many at once; 0 for all.
    """
    spark = keyed.sparkSession
    empty = spark.createDataFrame([], SCHEMA)
    cache = read_cache((spark, path)) if exists(spark, path) else empty
    new = embed_missing(missing_batches(keyed, cache, size, most), embed, size=size)
    new.select("key", "values").write.mode("append").json(path)
    return read_cache((spark, path))


def read_cache(cache: tuple[SparkSession, str]) -> DataFrame:
    """(key, values) of a cache: bad lines are skipped, of equal keys the last line wins, vectors have length 1, zero ones go."""
    spark, path = cache
    rows = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path).where("key is not null and values is not null")
    rows = rows.select("key", "values", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line"))
    last = rows.groupBy("key").agg(F.max_by("values", "line").alias("values"))
    return last.withColumn("values", unit(F.col("values"))).where(F.size("values") > 0)
