"""Q1 to Q13: every user turn of the conversations as a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.rules import Rules, all_of, any_of
from quarry.plans import planner as P
from quarry.plans import vocabulary as W
from quarry.queries.chunking import sql_first
from quarry.queries.shared import lit, read, sql_collapse, sql_tokens
from quarry.queries.tagging import sql_values

#: Our own vocabulary for the invented corpus.
ENTRIES = (
    P.Entry("base", "articles", ("the", "der"), ("definite article", "the"), ("what is the", "which one", "never used")),
    P.Entry("base", "endings", ("tion", "keit."), ("noun ending",)),
    P.Entry("more", "conjunctions", ("und", "y", "et"), ("and also",), ("this and that",)),
)
SYNONYMS = (("the", ("this", "that")), ("Der", ("dieser",)), ("ción", ("acción", "nación")))
INTENTS = ((("en ", "in "), ("where in the text", "place")), (("que",), ("what then",)))
CONCEPTS = [
    *all_of(1, "concept", "german", "contains_ci", ("der", "die"), ("und", "ein")),
    *any_of(2, "concept", "romance", "contains", "que", "les", "los"),
    *all_of(3, "concept", "english", "contains", ("the ",), ("of ", "and ")),
    *any_of(4, "concept", "german", "contains", "keit"),
]
FACETS = [*all_of(1, "facet", "place", "contains", ("en ", "in "), ("la ", "the ")), *any_of(2, "facet", "question", "contains", "?"), *any_of(3, "facet", "both", "contains_ci", "und", "and ")]
SOURCES = [*all_of(1, "source", "src1", "contains_ci", ("the",), ("of",)), *any_of(2, "source", "src2", "contains", "und "), *any_of(3, "source", "src3", "contains", "que ")]
PROFILES = {
    "german": {"concepts": ["noun", "case"], "target_parts": ["Grammar"], "evidence_wanted": ["Ending"], "required_facets": ["both"], "search_queries": ["german nouns", "cases of nouns", "und so weiter"]},
    "english": {"concepts": ["Noun", "article"], "target_parts": ["grammar", "Usage"], "avoided": ["spelling"], "search_queries": ["english articles", "German nouns"]},
    "romance": {"concepts": ["gender"], "evidence_wanted": ["ending", "accent"], "required_facets": ["place"], "search_queries": ["gender of nouns", "accents"]},
}
FIRST, SECOND = ("the", "der", "que"), ("in ", "en ", "la ")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """User turns, each with its turn number in the text, so that some have numbers."""
    rows = read(spark, d, "conversations").where("role = 'user'")
    text = F.when(F.col("turn") % 4 == 0, F.concat("text", F.lit(" "), F.col("turn").cast("string"))).otherwise(F.col("text"))
    return rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), text.alias("text"))


def _concepts() -> Column:
    return Rules(CONCEPTS).values(F.col("text"))


def _plan() -> dict[str, Column]:
    return P.plan(_concepts(), PROFILES)


def q1_matched_entries(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("query_id", F.array_join(P.matched(F.col("text"), ENTRIES), ",").alias("entries"))


def q2_expansions(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("query_id", F.array_join(P.expansions(F.col("text"), SYNONYMS, ENTRIES), "|").alias("terms"))


def q3_expanded_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("query_id", F.array_join(P.expanded_tokens(F.col("text"), SYNONYMS, ENTRIES), " ").alias("tokens"))


def q4_concepts(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("query_id", F.array_join(_concepts(), ",").alias("concepts"))


def q5_search_plan(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("query_id", *[F.array_join(c, "|").alias(f) for f, c in _plan().items()])


def q6_required_facets(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("query_id", F.array_join(F.array_sort(Rules(FACETS).values(F.col("text"))), ",").alias("facets"))


def _variants() -> Column:
    return P.variants(F.col("text"), SYNONYMS, ENTRIES, INTENTS, _plan()["search_queries"], [(Rules(FACETS), "facts: {query}", 1.02)])


def q7_variants(spark: SparkSession, d: str) -> DataFrame:
    return P.variant_table(_queries(spark, d), _variants()).select("query_id", F.col("variant_no").cast("long").alias("variant_no"), "label", "text", "weight")


def q8_variant_cap(spark: SparkSession, d: str) -> DataFrame:
    """Variants under the smallest cap, eight, counted."""
    made = P.variants(F.col("text"), SYNONYMS, ENTRIES, INTENTS, _plan()["search_queries"], [(Rules(FACETS), "facts: {query}", 1.02)], limit=1)
    return _queries(spark, d).select("query_id", F.size(made).cast("long").alias("n"))


def _intent() -> dict[str, Column]:
    return P.intent(F.col("text"), P.compares(F.col("text"), FIRST, SECOND), Rules(FACETS).values(F.col("text")), _plan())


def q9_intent(spark: SparkSession, d: str) -> DataFrame:
    made = _intent()
    return _queries(spark, d).select("query_id", "text", *[c.alias(f) for f, c in made.items()]).select("query_id", "question_type", F.array_join("required_facets", "|").alias("required_facets"), F.array_join("concepts", "|").alias("concepts"))


def q10_comparison(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("query_id", P.compares(F.col("text"), FIRST, SECOND).alias("compares"))


def q11_retrieval_text(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("query_id", P.retrieval_text(F.col("text"), _intent()).alias("retrieval"))


def q12_preferred_source(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("query_id", Rules(SOURCES).first(F.col("text")).alias("preferred"))


def q13_broad(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("query_id", P.broad(F.col("text"), Rules(FACETS).values(F.col("text")), ("question",), ("overview", "sch ")).alias("broad"))


def q1_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a keyword entry, of a word and a piece of its text, against every benchmark text: by joins."""
    entries = read(spark, d, "documents").select(F.col("source").alias("module"), F.col("doc_id").alias("entry_no"), F.col("doc_id").cast("string").alias("entry_id"), F.array(F.regexp_extract("text", "[A-Za-z0-9]{5,}", 0), F.substring("text", 12, 4)).alias("triggers"), F.array("lang", F.substring("text", 12, 4)).alias("expansions"))
    queries = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return W.matched(queries, entries).select("query_id", F.size("entries").cast("long").alias("n"), F.array_join("entries", ",").alias("entries"), F.sha1(F.array_join("expansions", "|")).alias("expansions"))


QUERIES = (q1_matched_entries, q1_vocabulary, q2_expansions, q3_expanded_tokens, q4_concepts, q5_search_plan, q6_required_facets, q7_variants, q8_variant_cap, q9_intent, q10_comparison, q11_retrieval_text, q12_preferred_source, q13_broad)

_Q = "q as (select conv_id * 100 + turn as query_id, case when turn % 4 = 0 then text || ' ' || turn else text end as x from conversations where role = 'user')"


def _trig(e: P.Entry) -> str:
    return "(" + " or ".join(f"regexp_matches(x, {lit(p)})" if (p := P.trigger_pattern(t)) else f"contains(lower(x), {lit(t.lower())})" for t in e.triggers) + ")"


def _arr(values) -> str:
    return "[" + ", ".join(map(lit, values)) + "]" if values else "cast([] as varchar[])"


_NONE = "cast([] as varchar[])"
_SYN = "flatten([" + ", ".join(f"case when contains(x, {lit(k)}) then {_arr(v)} else {_NONE} end" for k, v in SYNONYMS) + "])"
_EXP = f"list_concat({_SYN}, flatten([" + ", ".join(f"case when {_trig(e)} then {_arr(e.expansions)} else {_NONE} end" for e in ENTRIES) + "]))"
_EXPANDED = "x || case when len({0}) > 0 then ' ' || array_to_string({0}, ' ') else '' end".format(_EXP)
_DISTINCT = "list_filter({0}, lambda t, i: list_position({0}, t) = i)"
_CONCEPTS = _DISTINCT.format(sql_values(Rules(CONCEPTS)))
_FACETS = sql_values(Rules(FACETS))


def _field(f: str) -> str:
    raw = "flatten([" + ", ".join(f"case when list_contains({sql_values(Rules(CONCEPTS))}, '{c}') then {_arr(PROFILES[c].get(f, ()))} else {_NONE} end" for c in sorted(PROFILES)) + "])"
    return f"list_filter({raw}, lambda t, i: list_position(list_transform({raw}, lambda y: lower(y)), lower(t)) = i)"


def _var(label: str, text: str, weight: float) -> str:
    return f"{{'label': {lit(label)}, 'text': {text}, 'weight': cast({weight} as double)}}"


def variants_sql(cap: int, queries: str = _Q) -> str:
    empty = "cast([] as struct(label varchar, text varchar, weight double)[])"
    parts = [f"[{_var('original', 'x', 1.0)}]", f"case when len(syn) > 0 then [{_var('synonyms', 'x || chr(32) || array_to_string(syn, chr(32))', 0.9)}] else {empty} end", f"list_transform(planned[1:4], lambda t: {_var('plan', 't', 0.92)})"]
    for triggers, found in INTENTS:
        parts.append(f"case when {' or '.join(f'contains(x, {lit(t)})' for t in triggers)} then [{', '.join(_var('intent', lit(t), 0.84) for t in found)}] else {empty} end")
    for e in ENTRIES:
        if e.variant_queries:
            parts.append(f"case when {_trig(e)} then [{', '.join(_var('keyword:' + e.entry_id, lit(t), 0.84) for t in e.variant_queries[:2])}] else {empty} end")
    parts.append(f"case when len(fac) > 0 then [{_var('condition', lit('facts: ') + ' || x', 1.02)}] else {empty} end")
    return f"""{queries}, q2 as (select *, {_SYN} as syn, {_field('search_queries')} as planned, {_FACETS} as fac, {_EXPANDED} as expanded from q),
      a as (select query_id, expanded, list_transform(flatten([{', '.join(parts)}]), lambda v: {{'label': v.label, 'text': {sql_collapse('v.text')}, 'weight': v.weight}}) as vs from q2),
      b as (select query_id, expanded, list_filter(vs, lambda v, i: v.text <> '' and list_position(list_transform(vs, lambda w: lower(w.text)), lower(v.text)) = i)[1:{cap}] as vs from a),
      c as (select query_id, case when len(vs) = 1 then list_append(vs, {_var('tokens', 'array_to_string(' + _DISTINCT.format(sql_tokens('expanded')) + ', chr(32))', 0.84)}) else vs end as vs from b)"""


_COMPARES = "(regexp_matches(x, '[0-9]') and (" + " or ".join(f"contains(lower(x), {lit(t)})" for t in FIRST) + ") and (" + " or ".join(f"contains(lower(x), {lit(t)})" for t in SECOND) + "))"
_REQUIRED = f"list_filter(list_concat(list_sort(list_distinct({_FACETS})), {_field('required_facets')}), lambda t, i: list_position(list_concat(list_sort(list_distinct({_FACETS})), {_field('required_facets')}), t) = i)"
_INTENT = f"i as (select query_id, x, case when {_COMPARES} then 'comparison' else 'general' end as question_type, {_REQUIRED} as required_facets, " + ", ".join(f"{_field(f)} as {f}" for f in ("concepts", "target_parts", "evidence_wanted", "avoided")) + " from q)"

SQL = {
    "q1_matched_entries": f"with {_Q} select query_id, array_to_string(list_filter([" + ", ".join(f"case when {_trig(e)} then {lit(e.entry_id)} end" for e in ENTRIES) + "], lambda t: t is not null), ',') as entries from q",
    "q1_vocabulary": """with e as (select source, doc_id, lang || '|' || substr(text, 12, 4) as x, unnest([regexp_extract(text, '[A-Za-z0-9]{5,}'), substr(text, 12, 4)]) as t from documents),
        m as (select distinct item_id as query_id, source, doc_id, x from benchmark b join e on e.t <> '' and case when regexp_matches(e.t, '^[A-Za-z0-9][A-Za-z0-9_.+-]*$') then regexp_matches(b.text, '(?i)(?:^|[^A-Za-z0-9])' || regexp_escape(e.t) || '(?:[^A-Za-z0-9]|$)') else contains(lower(b.text), lower(e.t)) end)
        select item_id as query_id, count(doc_id) as n, coalesce(string_agg(doc_id, ',' order by source, doc_id), '') as entries, sha1(coalesce(string_agg(x, '|' order by source, doc_id), '')) as expansions from benchmark left join m on m.query_id = item_id group by item_id""",
    "q2_expansions": f"with {_Q} select query_id, array_to_string({_EXP}, '|') as terms from q",
    "q3_expanded_tokens": f"with {_Q}, e as (select query_id, {sql_tokens(_EXPANDED)} as t from q) select query_id, array_to_string({_DISTINCT.format('t').replace('lambda t, i: list_position(t, t)', 'lambda y, i: list_position(t, y)')}, ' ') as tokens from e",
    "q4_concepts": f"with {_Q} select query_id, array_to_string({_CONCEPTS}, ',') as concepts from q",
    "q5_search_plan": f"with {_Q} select query_id, " + ", ".join(f"array_to_string({_field(f)}, '|') as {f}" for f in P.FIELDS) + " from q",
    "q6_required_facets": f"with {_Q} select query_id, array_to_string(list_sort(list_distinct({_FACETS})), ',') as facets from q",
    "q7_variants": f"with {variants_sql(24)} select query_id, i - 1 as variant_no, v.label as label, v.text as text, v.weight as weight from (select query_id, unnest(vs) as v, generate_subscripts(vs, 1) as i from c)",
    "q8_variant_cap": f"with {variants_sql(8)} select query_id, cast(len(vs) as bigint) as n from c",
    "q9_intent": f"with {_Q}, {_INTENT} select query_id, question_type, array_to_string(required_facets, '|') as required_facets, array_to_string(concepts, '|') as concepts from i",
    "q10_comparison": f"with {_Q} select query_id, {_COMPARES} as compares from q",
    "q11_retrieval_text": f"with {_Q}, {_INTENT} select query_id, substr(array_to_string(list_filter(list_concat([x, {sql_collapse('x')}, question_type], required_facets, concepts, target_parts, evidence_wanted, avoided), lambda t: t <> ''), ' '), 1, 1400) as retrieval from i",
    "q12_preferred_source": f"with {_Q} select query_id, {sql_first(Rules(SOURCES), '')} as preferred from q",
    "q13_broad": f"with {_Q} select query_id, (list_contains({_FACETS}, 'question') or contains(lower(x), 'overview') or contains(lower(x), 'sch ')) as broad from q",
}
