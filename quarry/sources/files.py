"""Text files as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, text string"


def text_files(spark: SparkSession, roots: Sequence[str], extra: Sequence[str] = (), pattern: str = "*.md") -> DataFrame:
    """(path, text) of the files below roots that fit pattern, and of the extra files, each path once.

    Names that begin with `icon` and paths with a hidden part are left out. Bytes that aren't UTF-8 are dropped.
    """
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(r) for r in roots]
    parts += [spark.read.format("binaryFile").load(list(extra))] if extra else []
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    rows = parts[0].select("path", "content")
    for p in parts[1:]:
        rows = rows.union(p.select("path", "content"))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    rows = rows.where(~name.startswith("icon") & ~F.col("path").contains("/.")).dropDuplicates(["path"])
    text = F.replace(F.try_validate_utf8(F.col("content").cast("string")), F.lit("﻿"), F.lit(""))
    return rows.select("path", F.coalesce(text, F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "�", "")).alias("text"))
