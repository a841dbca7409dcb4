"""Conversations written as text files and as keyword modules, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.queries.shared import SQL_CONVS, md_convs, read, sql_tokens
from quarry.sources.files import text_files
from quarry.sources.keywords import keyword_entries
from quarry.sources.shared import shared_folder


def s1_text_files(spark: SparkSession, d: str) -> DataFrame:
    """A file per conversation, below two roots of which one is given twice."""
    folder, number = shared_folder(spark), F.regexp_extract("path", r"(\d+)", 1).cast("long")
    rows = md_convs(spark, d).select("text", F.when(number % 2 == 0, "even").otherwise("odd").alias("half"), number.alias("conv"))
    rows.write.partitionBy("half", "conv").text(folder)
    found = text_files(spark, [f"{folder}/half=even", f"{folder}/half=odd", f"{folder}/half=odd"], pattern="*.txt")
    return found.select(F.regexp_extract("path", r"/conv=(\d+)/", 1).cast("long").alias("conv_id"), "text")


def s2_keyword_modules(spark: SparkSession, d: str) -> DataFrame:
    """A module per conversation and an entry per turn, some without triggers or without anything to add."""
    folder, words = shared_folder(spark), T.tokenize("text")
    some = lambda keep, w: F.when(keep, w).otherwise(F.array().cast("array<string>"))
    entry = F.struct(F.concat(F.lit("t"), F.col("turn")).alias("id"), some(F.col("turn") % 4 != 3, F.slice(words, 1, 2)).alias("triggers"), F.concat(some(F.col("turn") % 3 != 0, F.slice(words, 3, 2)), F.array(F.lit(" "))).alias("expansions"), some(F.col("turn") % 3 == 1, F.slice(words, 5, 1)).alias("variant_queries"))
    rows = read(spark, d, "conversations").select("conv_id", "turn", entry.alias("entry")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "entry"))).alias("e"))
    name = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(" m"), F.col("conv_id"))).otherwise("m")
    rows.select(name.alias("name"), F.col("e.entry").alias("entries"), F.col("conv_id").alias("file")).write.partitionBy("file").json(folder)
    found = keyword_entries(spark, folder)
    return found.select("module", F.col("entry_no").cast("long").alias("entry_no"), "entry_id", *[F.array_join(c, "|").alias(c) for c in ("triggers", "expansions", "variant_queries")])


QUERIES = (s1_text_files, s2_keyword_modules)

SQL = {
    "s1_text_files": f"with {SQL_CONVS} select cast(regexp_extract(path, '([0-9]+)', 1) as bigint) as conv_id, text || chr(10) as text from files",
    "s2_keyword_modules": f"""with t as (select conv_id, turn, {sql_tokens('text')} as w, row_number() over (partition by conv_id order by turn) - 1 as entry_no from conversations),
        e as (select *, case when turn % 4 <> 3 then w[1:2] else [] end as triggers, case when turn % 3 <> 0 then w[3:4] else [] end as expansions, case when turn % 3 = 1 then w[5:5] else [] end as variant_queries from t)
        select case when conv_id % 2 = 0 then 'm' || conv_id else 'm' end as module, entry_no, 't' || turn as entry_id, array_to_string(triggers, '|') as triggers, array_to_string(expansions, '|') as expansions, array_to_string(variant_queries, '|') as variant_queries
        from e where len(triggers) > 0 and (len(expansions) > 0 or len(variant_queries) > 0)""",
}
