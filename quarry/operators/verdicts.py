"""Verdicts of a reviewer, which arrive as text, applied to tables of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T


def parsed(verdicts: DataFrame) -> DataFrame:
    """(query_id, ids, answerable, gaps) of (query_id, raw): places picked from 1, a flag (missing: true), gaps joined by '；'."""
    found = T.json_object("raw")
    ids = F.filter(F.transform(F.coalesce(F.from_json(F.when(found["selected_ids"].startswith("["), found["selected_ids"]), "array<string>"), F.array().cast("array<string>")), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    said = F.lower(F.trim(found["answerable"]))
    return verdicts.select("query_id", ids.alias("ids"), F.coalesce(~said.isin("false", "no", "0"), F.lit(True)).alias("answerable"), F.array_join(T.json_list(found["coverage_gaps"]), "；").alias("gaps"))


def selected(candidates: DataFrame, verdicts: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, rank, place): the candidates that a verdict picks, else the first; candidates: query_id, rank from 1.

    Places out of range and repeats are passed over; at most `most` are kept. A query without a verdict, or whose
    verdict picks nothing, gets its first `most` candidates.
    """
    picks = parsed(verdicts).select("query_id", F.posexplode("ids").alias("at", "rank"))
    once = Window.partitionBy("query_id", "rank").orderBy("at")
    picks = picks.withColumn("_n", F.row_number().over(once)).where("_n = 1").join(candidates.select("query_id", "rank"), ["query_id", "rank"])
    picks = picks.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).where(F.col("place") <= most).select("query_id", "rank", "place")
    rest = candidates.where(F.col("rank") <= most).join(picks.select("query_id").distinct(), "query_id", "left_anti")
    return picks.unionByName(rest.select("query_id", "rank", F.col("rank").alias("place")))


def overridden(state: DataFrame) -> DataFrame:
    """state with `answerable` and `use_first` decided from coverage.

    state: query_id, answerable (the verdict's), covered_selected, covered_all (coverage by the selected and by all
    candidates), comparison (whether the question compares). If the selected lack a facet that all candidates cover,
    the first candidates are used; if those lack it too, there is no answer; a covered comparison is answerable.
    """
    local = F.col("covered_selected") | F.col("covered_all")
    return state.withColumn("use_first", ~F.col("covered_selected") & F.col("covered_all")).withColumn("answerable", local & (F.col("answerable") | F.col("comparison")))


def says_no(review: Column, word: str) -> Column:
    return T.text(review).rlike(rf"(?i){word}\s*:\s*no(?:[^\p{{L}}\p{{N}}_]|$)")


def final_status(review: Column, verification: Column, comparison: Column, covered: Column, selected_any: Column, answerable: Column) -> Column:
    """`no_hits`, `unanswerable`, `unverified`, or `answered`; a covered comparison passes both reviews."""
    passes = comparison & covered
    return (
        F.when(~selected_any, "no_hits").when(~answerable | (says_no(review, "ANSWERABLE") & ~passes), "unanswerable")
        .when(says_no(verification, "VERIFIED") & ~passes, "unverified").otherwise("answered")
    )
