"""Plans for tables of queries: matched keyword entries, expansions, concepts, variants, intent.

Vocabularies are bounded tables written by people. They compile into array expressions over the query's row, so a plan
is one projection without a join or a shuffle, however many queries there are.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.rules import Rules

FIELDS = ("concepts", "target_parts", "evidence_wanted", "avoided", "required_facets", "search_queries")
_VARIANT = "array<struct<label:string,text:string,weight:double>>"


@dataclass(frozen=True)
class Entry:
    """A keyword entry: what triggers it, and what it adds to a query."""

    module: str
    entry_id: str
    triggers: tuple[str, ...]
    expansions: tuple[str, ...] = ()
    variant_queries: tuple[str, ...] = ()


def entries_of(table: DataFrame, most: int = 10_000) -> list[Entry]:
    """The entries of a table as sources.keywords gives it, in order; more than `most` are an error."""
    rows = table.orderBy("module", "entry_no").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} keyword entries: too many to compile into a plan; vocabulary.matched() joins tables of any size")
    return [Entry(r.module, r.entry_id, tuple(r.triggers), tuple(r.expansions), tuple(r.variant_queries)) for r in rows]


def texts(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def trigger_pattern(trigger: str) -> str | None:
    """For a plain ASCII word: the pattern of it between other characters; None: any substring will do."""
    word = re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.+-]*", trigger)
    return rf"(?i)(?:^|[^A-Za-z0-9]){re.escape(trigger)}(?:[^A-Za-z0-9]|$)" if word else None


def triggered(query: Column, triggers: Sequence[str]) -> Column:
    hits = [query.rlike(p) if (p := trigger_pattern(t)) else F.lower(query).contains(t.lower()) for t in triggers]
    return reduce(or_, hits, F.lit(False))


def matched(query: Column, entries: Sequence[Entry]) -> Column:
    """The ids of the entries that a query triggers, in order."""
    return F.array_compact(F.array(*[F.when(triggered(query, e.triggers), F.lit(e.entry_id)) for e in entries]))


def synonym_terms(query: Column, synonyms: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The terms of each key that the query contains, case counting."""
    return F.flatten(F.array(*[F.when(query.contains(key), texts(terms)).otherwise(texts(())) for key, terms in synonyms]))


def expansions(query: Column, synonyms: Sequence[tuple[str, Sequence[str]]], entries: Sequence[Entry]) -> Column:
    own = F.flatten(F.array(*[F.when(triggered(query, e.triggers), texts(e.expansions)).otherwise(texts(())) for e in entries]))
    return F.concat(synonym_terms(query, synonyms), own)


def expanded_tokens(query: Column, synonyms: Sequence[tuple[str, Sequence[str]]], entries: Sequence[Entry]) -> Column:
    """Distinct tokens of the query and its expansions, in order."""
    return F.array_distinct(T.tokenize(F.concat_ws(" ", query, expansions(query, synonyms, entries))))


def plan(concepts: Column, profiles: dict[str, dict[str, Sequence[str]]]) -> dict[str, Column]:
    """Per field, what the profiles of a query's concepts say, concepts in order of name, repeats left out."""
    return {f: T.dedupe(F.flatten(F.array(*[F.when(F.array_contains(concepts, c), texts(profiles[c].get(f, ()))).otherwise(texts(())) for c in sorted(profiles)]))) for f in FIELDS}


def variants(query: Column, synonyms: Sequence[tuple[str, Sequence[str]]], entries: Sequence[Entry], intents: Sequence[tuple[Sequence[str], Sequence[str]]], plan_queries: Column, conditional: Sequence[tuple[Rules, str, float]] = (), limit: int = 24) -> Column:
    """A query's variants as an array of (label, text, weight), each text once, the first weight holding.

    The query itself, with synonyms, the first four plan queries, intent texts, the first two of each matched entry,
    and conditional ones (rules, text, weight) with {query} for the query. A query with no other variant gets its
    expanded tokens.
    """
    one = lambda label, text, weight: F.struct(F.lit(label).alias("label"), text.alias("text"), F.lit(float(weight)).alias("weight"))
    none = F.array().cast(_VARIANT)
    terms = synonym_terms(query, synonyms)
    parts = [F.array(one("original", query, 1.0)), F.when(F.size(terms) > 0, F.array(one("synonyms", F.concat_ws(" ", query, terms), 0.9))).otherwise(none)]
    parts.append(F.transform(F.slice(plan_queries, 1, 4), lambda t: one("plan", t, 0.92)))
    for triggers, found in intents:
        parts.append(F.when(reduce(or_, [query.contains(t) for t in triggers]), F.array(*[one("intent", F.lit(t), 0.84) for t in found])).otherwise(none))
    for e in entries:
        if e.variant_queries:
            parts.append(F.when(triggered(query, e.triggers), F.array(*[one(f"keyword:{e.entry_id}", F.lit(t), 0.84) for t in e.variant_queries[:2]])).otherwise(none))
    for rules, text, weight in conditional:
        parts.append(F.when(rules.any(query), F.array(one("condition", F.replace(F.lit(text), F.lit("{query}"), query), weight))).otherwise(none))
    every = F.filter(F.transform(F.concat(*[p.cast(_VARIANT) for p in parts]), lambda v: F.struct(v["label"].alias("label"), T.collapse(v["text"]).alias("text"), v["weight"].alias("weight"))), lambda v: v["text"] != "")
    once = lambda all_, keys: F.slice(F.filter(all_, lambda v, i: F.array_position(keys, F.lower(v["text"])) == i + 1), 1, max(8, limit))
    more = F.array(one("tokens", F.array_join(expanded_tokens(query, synonyms, entries), " "), 0.84)).cast(_VARIANT)
    first = T.let(every, lambda all_: T.let(F.transform(all_, lambda v: F.lower(v["text"])), lambda keys: once(all_, keys)))
    return T.let(first, lambda found: F.when(F.size(found) == 1, F.concat(found, more)).otherwise(found))


def variant_table(queries: DataFrame, made: Column) -> DataFrame:
    """(query_id, variant_no, label, text, weight) of an array that variants() made."""
    return queries.select("query_id", F.posexplode(made).alias("variant_no", "v")).select("query_id", "variant_no", "v.label", "v.text", "v.weight")


def compares(query: Column, first: Sequence[str], second: Sequence[str]) -> Column:
    """Whether a query has a number, a term of the first topic, and one of the second."""
    low = F.lower(query)
    return query.rlike("[0-9]") & reduce(or_, [low.contains(t) for t in first]) & reduce(or_, [low.contains(t) for t in second])


def intent(query: Column, comparison: Column, facets: Column, planned: dict[str, Column]) -> dict[str, Column]:
    """A query's intent by rule: its type, sorted facets, and the plan's lists."""
    return {
        "intent_text": T.collapse(query), "question_type": F.when(comparison, "comparison").otherwise("general"),
        "required_facets": T.dedupe(F.concat(F.array_sort(F.array_distinct(facets)), planned["required_facets"])),
        **{f: planned[f] for f in ("concepts", "target_parts", "evidence_wanted", "avoided")},
    }


def retrieval_text(query: Column, wanted: dict[str, Column], planner: Column | None = None, chars: int = 1400) -> Column:
    """The query, its intent's texts and the planner's, in a row, cut."""
    plain = [wanted["intent_text"], wanted["question_type"]]
    lists = [wanted[f] for f in ("required_facets", "concepts", "target_parts", "evidence_wanted", "avoided")]
    return F.substring(F.array_join(F.filter(F.flatten(F.array(F.array(query, *plain), *lists, F.array(planner) if planner is not None else texts(()))), lambda x: F.coalesce(x, F.lit("")) != ""), " "), 1, chars)


def broad(query: Column, facets: Column, broad_facets: Sequence[str], terms: Sequence[str]) -> Column:
    """Whether a question asks for whole sections, by a facet or a term."""
    return F.exists(facets, lambda f: f.isin(*broad_facets)) | reduce(or_, [F.lower(query).contains(t) for t in terms])
