"""Keyword modules: JSON files {name, entries: [{id, triggers, expansions, variant_queries}]}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import strip, text

_ENTRY = "struct<id:string,triggers:array<string>,expansions:array<string>,variant_queries:array<string>>"


def _terms(c: str) -> Column:
    return F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: strip(text(x))), lambda x: x != "")


def keyword_entries(spark: SparkSession, path: str) -> DataFrame:
    """(module, entry_no, entry_id, triggers, expansions, variant_queries) of the modules below path.

    Files that don't parse and entries that aren't objects are skipped; an entry counts if it has a trigger and an
    expansion or variant. The module is the file's name where it has none of its own.
    """
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    rows = files.select("file", F.from_json("value", "name string, entries array<string>").alias("m")).where("m is not null")
    rows = rows.select(F.coalesce(F.nullif(F.trim("m.name"), F.lit("")), F.regexp_replace("file", r"\.json$", "")).alias("module"), F.posexplode("m.entries").alias("entry_no", "raw"))
    rows = rows.select("module", "entry_no", F.from_json("raw", _ENTRY).alias("e")).where("e is not null").select("module", "entry_no", F.coalesce("e.id", F.lit("")).alias("entry_id"), "e.triggers", "e.expansions", "e.variant_queries")
    rows = rows.select("module", "entry_no", "entry_id", *[_terms(c).alias(c) for c in ("triggers", "expansions", "variant_queries")])
    return rows.where((F.size("triggers") > 0) & ((F.size("expansions") > 0) | (F.size("variant_queries") > 0)))
