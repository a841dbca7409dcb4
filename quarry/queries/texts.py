"""Text functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.excerpt import excerpt, parent_excerpt
from quarry.queries.shared import NAME_ENDS, NAME_MARKS, lit, read, sql_clean_name, sql_collapse, sql_excerpt, sql_strip, sql_tokens


def f1_tokenize(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", T.tokenize("text").alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def f2_indexed_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents")
    tokens = T.indexed_tokens(F.col("source"), F.col("doc_id").cast("string"), F.col("lang"), F.lit("text"), F.array(F.concat(F.lit("lang:"), "lang"), F.lit("has_text")), F.col("text"))
    return rows.select("doc_id", F.array_join(tokens, " ").alias("tokens"))


def f3_clean_cell(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.clean_cell("html").alias("cell"))


def f4_tidy_label(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat(F.lit("_- "), F.col("source"), F.lit(" - "), F.col("lang"), F.lit("--x "), F.substring("text", 1, 80), F.lit(" -"))
    return read(spark, d, "documents").select("doc_id", T.tidy_label(label).alias("label"))


def f5_context_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", T.context_text("text").alias("context"))


def f6_clean_name(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", T.clean_name("text", NAME_ENDS, NAME_MARKS).alias("name"))


def f7_jaccard(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "documents").select("doc_id", T.tokenize("text").alias("a"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return a.join(b, "doc_id").select("doc_id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


def f8_json_object(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Answer: "), "props", F.lit(" end."))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("bad { "), F.col("event_type"))).otherwise(F.col("props"))
    found = T.json_object(raw)
    return read(spark, d, "events").select("event_id", F.size(found).cast("long").alias("n_keys"), F.coalesce(found["k"], F.lit("")).alias("k"))


def f9_json_list(spark: SparkSession, d: str) -> DataFrame:
    words = T.tokenize("text")
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('["'), F.array_join(F.slice(words, 1, 3), '", " '), F.lit('", ""]'))).otherwise(F.concat(F.lit(" "), F.array_join(F.slice(words, 1, 2), " "), F.lit(" ")))
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.json_list(raw), "|").alias("items"))


def f10_best_excerpt(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", "text", F.slice(T.tokenize("text"), 20, 6).alias("q"))
    return rows.select("doc_id", excerpt(F.col("text"), F.col("q"), 520).alias("excerpt"))


def f11_parent_excerpt(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", "text", F.substring("text", 1, 400).alias("chunk"), F.slice(T.tokenize("text"), 20, 6).alias("q"))
    return rows.select("doc_id", parent_excerpt(F.col("text"), F.col("chunk"), F.col("q")).alias("excerpt"))


def f12_trailing_question(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("turn") % 3 == 0, "\n\nCould you say more?").when(F.col("turn") % 3 == 1, " And so it is. What is it?").otherwise("\n\n\nNo question.")
    return read(spark, d, "conversations").select("conv_id", "turn", T.without_trailing_question(F.concat("text", tail)).alias("answer"))


def g5_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.dedupe(F.split("text", " ")), " ").alias("terms"))


QUERIES = (f1_tokenize, f2_indexed_tokens, f3_clean_cell, f4_tidy_label, f5_context_text, f6_clean_name, f7_jaccard, f8_json_object, f9_json_list, f10_best_excerpt, f11_parent_excerpt, f12_trailing_question, g5_dedupe)


def _clean_cell(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for name, value in T.ENTITIES:
        out = f"replace({out}, {lit(name)}, {lit(value)})"
    return f"regexp_replace(regexp_replace({out}, {lit(T.WS + '+')}, ' ', 'g'), '^[ •\\t\\r\\n]+|[ •\\t\\r\\n]+$', '', 'g')"


sql_clean_cell = _clean_cell

_EXCERPT = f"with s as (select doc_id, text, {sql_tokens('text')}[20:25] as q from documents)"

SQL = {
    "f10_best_excerpt": f"{_EXCERPT}, {sql_excerpt('s', 'x', 520)} select doc_id, excerpt from x",
    "f11_parent_excerpt": f"{_EXCERPT}, {sql_excerpt('s', 'x', 1800)} select doc_id, case when coalesce(text, '') = '' or text = substr(text, 1, 400) then '' else excerpt end as excerpt from x",
    "f1_tokenize": f"select doc_id, cast(len(t) as bigint) as n_tokens, array_to_string(t, ' ') as tokens from (select doc_id, {sql_tokens('text')} as t from documents)",
    "f2_indexed_tokens": "select doc_id, array_to_string(" + sql_tokens("source || ' ' || doc_id || ' ' || lang || ' text lang:' || lang || ' has_text' || chr(10) || text") + ", ' ') as tokens from documents",
    "f3_clean_cell": f"select page_id, {_clean_cell('html')} as cell from pages",
    "f4_tidy_label": "select doc_id, regexp_replace(replace(replace(regexp_replace('_- ' || source || ' - ' || lang || '--x ' || substr(text, 1, 80) || ' -', " + lit(T.WS + "+") + ", ' ', 'g'), ' - ', ' '), '--', '-'), '^[ _-]+|[ _-]+$', '', 'g') as label from documents",
    "f5_context_text": f"select conv_id, turn, substr({sql_collapse('text')}, 1, 700) as context from conversations",
    "f6_clean_name": f"select conv_id, turn, {sql_clean_name('text')} as name from conversations",
    "f7_jaccard": f"""with t as (select doc_id, list_distinct({sql_tokens('text')}) as s from documents)
        select a.doc_id, case when len(a.s) > 0 and len(b.s) > 0 then round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) else 0.0 end as similarity
        from t a join t b on b.doc_id = a.doc_id + 1""",
    "f8_json_object": "select event_id, cast(case when event_id % 3 = 1 then 0 else len(json_keys(props)) end as bigint) as n_keys, case when event_id % 3 = 1 then '' else coalesce(json_extract_string(props, '$.k'), '') end as k from events",
    "f9_json_list": f"""with t as (select conv_id, turn, {sql_tokens('text')} as w from conversations)
        select conv_id, turn, case when turn % 2 = 0 then array_to_string(list_filter(w[1:3], lambda x: x <> ''), '|') else trim(array_to_string(w[1:2], ' ')) end as items from t""",
    "f12_trailing_question": f"""with t as (select conv_id, turn, {sql_strip("text || case turn % 3 when 0 then chr(10) || chr(10) || 'Could you say more?' when 1 then ' And so it is. What is it?' else chr(10) || chr(10) || chr(10) || 'No question.' end")} as t from conversations),
        p as (select *, list_filter(list_transform(regexp_split_to_array(t, '\\n{{2,}}'), lambda x: {sql_strip('x')}), lambda x: x <> '') as p from t),
        s as (select *, p[-1] as q, regexp_extract(p[-1], '(?s)^(.*[。.!！]){T.WS}*([^。.!！]*)$', ['a', 'b']) as m from p)
        select conv_id, turn, case when regexp_matches(q, '[？?]{T.WS}*$') and ({' or '.join(f"starts_with(case when m.a = '' then q else {sql_strip('m.b')} end, '{s}')" for s in ('Could you', 'May I', 'What', 'How'))} or length(case when m.a = '' then q else {sql_strip('m.b')} end) <= 120)
          then {sql_strip("array_to_string(list_filter(list_append(p[:-2], regexp_replace(m.a, '([。.!！])" + T.WS + "+', '\\1', 'g')), lambda x: x <> ''), chr(10) || chr(10))")} else t end as answer from s""",
    "g5_dedupe": """with t as (select conv_id, turn, list_filter(list_transform(string_split(text, ' '), lambda x: trim(x)), lambda x: x <> '') as w from conversations)
        select conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i), ' ') as terms from t""",
}
