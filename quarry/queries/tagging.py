"""Tags and facets. Each document stands for a chunk: label source, title doc_id, section lang, type text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import tags as G
from quarry.operators.rules import Rules, all_of, any_of
from quarry.plans import vocabulary as W
from quarry.queries.chunking import sql_fires, sql_first
from quarry.queries.shared import lit, read

_W = "(^|[^a-z])(%s)([^a-z]|$)"
#: Our own rules for the invented corpus.
TOPICS = [
    *any_of(1, "topic", "english", "regex", _W % "the|and|with"),
    *any_of(2, "topic", "german", "regex", _W % "und|der|nicht"),
    *any_of(3, "topic", "french", "regex", _W % "les|dans|pour"),
    *any_of(4, "topic", "spanish", "regex", _W % "los|para|que"),
    *all_of(5, "topic", "licensed", "contains", ("license",), ("under the",)),
    *any_of(6, "topic", "mail", "contains", "@"),
    (7, "topic", 1, "contains", "src1", False, "not_english"), (7, "topic", 2, "regex", _W % "the", True, "not_english"),
]
FAMILIES = [*any_of(1, "family", "first", "contains", "src1 "), *any_of(2, "family", "tens", "contains", "src1"), *any_of(3, "family", "other", "contains", "src")]
PRESENCE = {"has_table": "[|]", "has_number": "[0-9]", "has_threshold": "[<>=] ?[0-9]"}
ONTOLOGY = [
    *any_of(1, "language", "german", "regex", _W % "ein|eine|einen"),
    *any_of(2, "language", "french", "regex", _W % "une|des"),
    *any_of(3, "contact", "phone", "regex", "[+][0-9]"),
    *any_of(4, "contact", "mail", "contains", "@mail"),
    *any_of(5, "number", "near_the", "regex", G.near_number("the")),
    *any_of(6, "number", "near_en", "regex", G.near_number("en ")),
]
TITLE = "'chapter ' || doc_id"


def _hay() -> Column:
    title = F.concat(F.lit("chapter "), F.col("doc_id").cast("string"))
    return G.haystack(F.col("source"), title, F.col("lang"), F.lit("text"), F.col("text"), F.col("text"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").withColumn("hay", _hay())


def _metadata() -> Column:
    return F.concat(Rules(TOPICS).values(F.col("hay")), G.captured(F.col("hay"), Rules(FAMILIES), F.lit("text")), G.presence(F.col("hay"), PRESENCE), G.ontology(F.col("hay"), Rules(ONTOLOGY)))


def g1_topics(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_join(Rules(TOPICS).values(F.col("hay")), ",").alias("tags"))


def g1_rule_table(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a rule, of pieces of its text that must occur, or mustn't, against all documents."""
    docs = read(spark, d, "documents").where("text is not null")
    made = [(1, "contains_ci", 6, 6, False), (2, "contains", 21, 4, False), (2, "contains", 40, 4, False), (3, "contains", 60, 5, True)]
    terms = F.array(*[F.struct(F.lit(c).alias("clause_no"), F.lit(kind).alias("kind"), F.substring("text", at, n).alias("term"), F.lit(negate).alias("negate")) for c, kind, at, n, negate in made])
    rows = W.fired_lists(docs.select(F.col("doc_id").alias("id"), "text"), docs.select(F.col("doc_id").alias("rule_no"), F.explode(terms).alias("t")).select("rule_no", "t.*"))
    return rows.select(F.col("id").alias("doc_id"), F.size("rules").cast("long").alias("n"), F.array_join(F.transform("rules", lambda x: x.cast("string")), ",").alias("rules"))


def g2_captured(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_join(G.captured(F.col("hay"), Rules(FAMILIES), F.lit("text")), ",").alias("tags"))


def g3_presence(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_join(G.presence(F.col("hay"), PRESENCE), ",").alias("tags"))


def g4_ontology(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_join(G.ontology(F.col("hay"), Rules(ONTOLOGY)), ",").alias("tags"))


def g6_facets(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("text").contains(" | "), "table_row").otherwise("text")
    hay = F.lower(F.concat_ws(" ", "source", "lang", kind, F.substring("text", 1, 700), F.substring("text", 1, 900)))
    rows = read(spark, d, "documents").withColumn("x", hay)
    return rows.select("doc_id", F.array_join(G.facets(F.col("x"), Rules(TOPICS), kind, Rules(FAMILIES).first(F.col("x"))), ",").alias("facets"))


def g7_tag_table(spark: SparkSession, d: str) -> DataFrame:
    rows = G.tag_table(_docs(spark, d).select("doc_id", _metadata().alias("metadata")), "doc_id")
    return rows.groupBy("category", "tag").agg(F.count("*").alias("n"))


QUERIES = (g1_topics, g1_rule_table, g2_captured, g3_presence, g4_ontology, g6_facets, g7_tag_table)

_HAY = f"h as (select doc_id, lower(source || ' ' || {TITLE} || ' ' || lang || ' text ' || text || ' ' || substr(text, 1, 1400)) as x from documents)"


def _list(items: list[str]) -> str:
    return "list_filter([" + ", ".join(items) + "], lambda t: t is not null)"


def sql_values(rules: Rules, prefix: bool = False) -> str:
    return _list([f"case when {sql_fires(r)} then {lit((f'ontology:{r.target}:' if prefix else '') + r.value)} end" for r in rules.rules])


_CAPTURED = _list([
    f"case when {sql_first(Rules(FAMILIES), '')} <> '' then 'source:' || {sql_first(Rules(FAMILIES), '')} end",
    *[f"case when regexp_extract(x, {lit(p)}, {g}) <> '' then '{name}:' || {cast % f'regexp_extract(x, {lit(p)}, {g})'} end" for name, p, g, cast in (("year", G.YEAR, 1, "%s"), ("chapter", G.CHAPTER, 1, "cast(cast(%s as int) as varchar)"), ("recommendation", G.NUMBER, 1, "%s"), ("grade", G.NUMBER, 2, "%s"))],
    "'chunk_type:text'",
])
_PRESENCE = _list([f"case when regexp_matches(x, {lit(p)}) then '{tag}' end" for tag, p in PRESENCE.items()])

SQL = {
    "g1_topics": f"with {_HAY} select doc_id, array_to_string({sql_values(Rules(TOPICS))}, ',') as tags from h",
    "g1_rule_table": """with r as (select doc_id as rule_no, substr(text, 6, 6) as a, substr(text, 21, 4) as b, substr(text, 40, 4) as c, substr(text, 60, 5) as x from documents where text is not null and length(text) >= 6),
        m as (select doc_id, rule_no from documents d join r on contains(lower(text), lower(a)) and (b = '' or contains(text, b) or (c <> '' and contains(text, c))) and not (x <> '' and contains(text, x)))
        select doc_id, count(*) as n, string_agg(rule_no, ',' order by rule_no) as rules from m group by doc_id""",
    "g2_captured": f"with {_HAY} select doc_id, array_to_string({_CAPTURED}, ',') as tags from h",
    "g3_presence": f"with {_HAY} select doc_id, array_to_string({_PRESENCE}, ',') as tags from h",
    "g4_ontology": f"with {_HAY} select doc_id, array_to_string({sql_values(Rules(ONTOLOGY), True)}, ',') as tags from h",
    "g6_facets": f"""with k as (select doc_id, case when contains(text, ' | ') then 'table_row' else 'text' end as kind, source, lang, text from documents),
        h as (select doc_id, kind, lower(source || ' ' || lang || ' ' || kind || ' ' || substr(text, 1, 700) || ' ' || substr(text, 1, 900)) as x from k)
        select doc_id, array_to_string(list_sort(list_distinct(list_concat({sql_values(Rules(TOPICS))}, {_list(["case when kind = 'table_row' then 'table' end", f"case when {sql_first(Rules(FAMILIES), '')} <> '' then 'source_' || {sql_first(Rules(FAMILIES), '')} end"])}))), ',') as facets from h""",
    "g7_tag_table": f"""with {_HAY}, t as (select unnest(list_concat({sql_values(Rules(TOPICS))}, {_CAPTURED}, {_PRESENCE}, {sql_values(Rules(ONTOLOGY), True)})) as tag from h)
        select case when contains(tag, ':') then string_split(tag, ':')[1] else '' end as category, tag, count(*) as n from t group by all""",
}
