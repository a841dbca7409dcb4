"""Tables as views that several queries start from, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T


#: Our own words and marks that end a name.
NAME_ENDS, NAME_MARKS = ("and", "or", "but", "who", "is", "der", "que"), (",", ";", "!", "?", "ß")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^{T.WS}+|{T.WS}+$')}, '', 'g')"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(T.WS + '+')}, ' ', 'g'))"


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), {lit(T.TOKEN)}), lambda t: length(t) > 1 or regexp_matches(t, {lit(T.ONE)}))"


def sql_clean_name(x: str) -> str:
    """clean_name() with our words and marks."""
    marks = f"(?s)(?:{'|'.join(map(re.escape, NAME_MARKS))}).*$"
    for pattern, into in ((T.name_end(NAME_ENDS), "\\1"), (marks, ""), (T.WS + "+", " "), (f"^{T.NAME_STRIP}+|{T.NAME_STRIP}+$", "")):
        x = f"regexp_replace({x}, {lit(pattern)}, {lit(into)}, 'g')"
    return f"substr({x}, 1, 20)"


def sql_excerpt(source: str, name: str, chars: int) -> str:
    """Common table expressions from source (text, q: tokens, and more) to name, with excerpt."""
    return f"""{name}_1 as (select *, {sql_collapse("coalesce(text, '')")} as flat, list_transform(list_filter(q, lambda t: t <> ''), lambda t: lower(t)) as toks from {source}),
    {name}_2 as (select *, string_split(regexp_replace(flat, '([.!?。！？]) ', '\\1' || chr(10), 'g'), chr(10)) as parts from {name}_1),
    {name}_3 as (select *, list_transform(parts, lambda s: len(list_filter(toks, lambda t: contains(lower(s), t)))) as points from {name}_2),
    {name}_4 as (select *, list_max(points) as most, list_position(points, list_max(points)) as best from {name}_3),
    {name}_5 as (select *, list_filter(flatten(list_transform(range(1, len(parts) + 1), lambda k: [best - k, best + k])), lambda i: i >= 1 and i <= len(parts)) as visits from {name}_4),
    {name}_6 as (select *, list_reduce(list_prepend({{'size': length(parts[best]), 'chosen': [best], 'seen': 0}}, list_transform(visits, lambda i: {{'size': length(parts[i]), 'chosen': [i], 'seen': 1}})), lambda acc_, new_:
        case when acc_.size >= {chars} then acc_ when acc_.size + 1 + new_.size <= {chars} then {{'size': acc_.size + 1 + new_.size, 'chosen': list_concat(acc_.chosen, new_.chosen), 'seen': acc_.seen + 1}} else {{'size': acc_.size, 'chosen': acc_.chosen, 'seen': acc_.seen + 1}} end) as r from {name}_5),
    {name}_7 as (select *, visits[r.seen + 1:] as rest, coalesce(list_min(list_filter(list_transform(toks, lambda t: instr(lower(flat), t)), lambda p: p > 0)), 1) - 1 as f from {name}_6),
    {name}_8 as (select *, least(length(flat), greatest(0, f - {chars // 3}) + {chars}) as fin from {name}_7),
    {name} as (select *, case when length(flat) <= {chars} then flat
        when len(parts) > 1 and most > 0 then (case when len(list_filter(rest, lambda i: i < best)) > 0 then '...' else '' end) || array_to_string(list_transform(list_sort(r.chosen), lambda i: parts[i]), ' ') || (case when len(list_filter(rest, lambda i: i > best)) > 0 then '...' else '' end)
        else (case when fin - {chars} > 0 then '...' else '' end) || trim(substr(flat, greatest(0, fin - {chars}) + 1, fin - greatest(0, fin - {chars}))) || (case when fin < length(flat) then '...' else '' end) end as excerpt from {name}_8)"""


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files without headings: (path, text)."""
    return read(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")


def md_convs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files with a heading per turn: (path, text)."""
    turn = F.concat(F.lit("## "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))).alias("all"))
    return rows.select(F.concat(F.lit("convs/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.array_join(F.col("all.t"), "\n").alias("text"))


SQL_DOCS = "files as (select source || '/' || doc_id || '.md' as path, text from documents)"
SQL_CONVS = "files as (select 'convs/' || conv_id || '.md' as path, string_agg('## ' || role || ' ' || turn || chr(10) || text, chr(10) order by turn) as text from conversations group by conv_id)"
