"""What selected hits cover: greedy re-rank, coverage check, second pass, whole sections, evidence packs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T


@dataclass(frozen=True)
class Weights:
    """Gains and losses of the greedy re-rank; missing: extra loss for a required facet that a hit lacks."""

    target: float = 0.42
    general: float = 0.12
    general_most: int = 3
    general_free: float = 0.03
    general_free_most: int = 2
    new_source: float = 0.08
    new_section: float = 0.08
    other_source: float = 0.85
    no_target: float = 0.45
    each_missing: float = 0.12
    same_place: float = 0.35
    similar: float = 0.25
    similarity: float = 0.62
    missing: dict[str, float] = field(default_factory=dict)


def _members(lists: Sequence[Sequence[str]]) -> tuple[np.ndarray, dict[str, int]]:
    """Which row has which value, as a matrix, and the values' columns."""
    place = {v: k for k, v in enumerate(dict.fromkeys(v for own in lists for v in own))}
    out = np.zeros((len(lists), len(place)), bool)
    for i, own in enumerate(lists):
        out[i, [place[v] for v in own]] = True
    return out, place


def _pick(pool: pd.DataFrame, required: set[str], preferred: str, limit: int, w: Weights) -> list[int]:
    """Places of the chosen rows, in order of choice; of equal values the first row wins.

    All pairs are compared once; each choice then only adds one row of the matrices to what counts as seen.
    """
    n = len(pool)
    facets, place = _members(pool["facets"].tolist())
    wanted = np.array([v in required for v in place], bool)
    tokens = _members(pool["tokens"].tolist())[0].astype(np.int64)
    both, sizes = tokens @ tokens.T, tokens.sum(axis=1)
    close = both > w.similarity * np.maximum(1, sizes[:, None] + sizes - both)
    same = {c: (values := pool[c].to_numpy())[:, None] == values for c in ("source", "section", "chunk_type")}
    same_place = same["source"] & same["section"] & same["chunk_type"]

    score = pool["score"].to_numpy(float)
    top = score.max() if n and score.max() else 1.0
    value = score / top
    if preferred:
        value = value - w.other_source * ~pool["source_label"].str.lower().str.contains(preferred, regex=False).to_numpy(bool)
    if required:
        has = (facets & wanted).sum(axis=1)
        value = value - w.no_target * (has == 0) - w.each_missing * (len(required) - has)
        for facet, loss in w.missing.items():
            if facet in required:
                value = value - loss * ~(facets[:, place[facet]] if facet in place else np.zeros(n, bool))
    each, most = (w.general, w.general_most) if required else (w.general_free, w.general_free_most)

    chosen: list[int] = []
    covered, seen = np.zeros(len(place), bool), {k: np.zeros(n, bool) for k in ("source", "section", "place", "close")}
    left = np.ones(n, bool)
    while left.any() and len(chosen) < limit:
        fresh = facets & ~covered
        gain = w.target * (fresh & wanted).sum(axis=1) + each * np.minimum(fresh.sum(axis=1), most)
        if chosen:
            gain = gain + w.new_source * ~seen["source"] + w.new_section * ~seen["section"] - w.same_place * seen["place"] - w.similar * seen["close"]
        # values at or below -1 count as equal, so the first of them is taken
        i = int(np.argmax(np.where(left, np.maximum(np.round(value + gain, 12), -1.0), -np.inf)))
        chosen.append(i)
        left[i] = False
        covered |= facets[i]
        for k, matrix in (("source", same["source"]), ("section", same["section"]), ("place", same_place), ("close", close)):
            seen[k] |= matrix[i]
    return chosen


def rerank(hits: DataFrame, limit: int, weights: Weights = Weights()) -> DataFrame:
    """(query_id, chunk_id, place): hits chosen one by one for score, new facets and variety.

    hits: query_id, chunk_id, rank, score, source, source_label, section, chunk_type, excerpt, facets, required (of the
    query), preferred (source, may be empty); a group is a query's pool of at most some multiples of limit.
    """
    rows = hits.withColumn("tokens", T.tokenize("excerpt")).drop("excerpt")
    key, chunk = hits.schema["query_id"].dataType.simpleString(), hits.schema["chunk_id"].dataType.simpleString()

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "rank", "chunk_id"], ascending=[False, True, True], kind="stable")
        preferred = frame["preferred"].iloc[0] or ""
        if preferred:
            other = ~frame["source_label"].str.lower().str.contains(preferred, regex=False)
            frame = frame.assign(_o=other).sort_values("_o", kind="stable")
        frame = frame.head(3 * limit)
        chosen = _pick(frame, set(frame["required"].iloc[0]), preferred, limit, weights)
        return pd.DataFrame({"query_id": frame["query_id"].iloc[chosen].tolist(), "chunk_id": frame["chunk_id"].iloc[chosen].tolist(), "place": range(1, len(chosen) + 1)})

    return rows.groupBy("query_id").applyInPandas(choose, f"query_id {key}, chunk_id {chunk}, place int")


def coverage(queries: DataFrame, hits: DataFrame, allowed: Sequence[str] | None = None) -> DataFrame:
    """(query_id, required, covered, missing, answerable) per query.

    queries: query_id, required, intent (facet arrays); intent facets count if allowed. hits: query_id, facets. Without
    required facets a query is answerable if it has any hit.
    """
    intent = F.col("intent") if allowed is None else F.filter("intent", lambda f: f.isin(*allowed))
    need = queries.select("query_id", F.array_sort(F.array_distinct(F.concat("required", intent))).alias("required"))
    found = hits.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("facets")))).alias("covered"), F.count("*").alias("n"))
    rows = need.join(found, "query_id", "left").withColumn("covered", F.coalesce("covered", F.array().cast("array<string>")))
    rows = rows.withColumn("missing", F.array_except("required", "covered"))
    answerable = F.when(F.size("required") > 0, F.size("missing") == 0).otherwise(F.coalesce("n", F.lit(0)) > 0)
    return rows.select("query_id", "required", "covered", "missing", answerable.alias("answerable"))


def second_pass(covered: DataFrame, templates: DataFrame, queries: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, pass_no, text): up to `most` further queries for missing facets, by facet, each text once.

    templates: facet, item_no, text with {query} for the query's own words; queries: query_id, text.
    """
    rows = covered.select("query_id", F.explode("missing").alias("facet")).join(templates.select("facet", "item_no", F.col("text").alias("t")), "facet").join(queries.select("query_id", "text"), "query_id")
    rows = rows.select("query_id", "facet", "item_no", T.collapse(F.replace("t", F.lit("{query}"), F.col("text"))).alias("text"))
    once = Window.partitionBy("query_id", F.lower("text")).orderBy("facet", "item_no")
    rows = rows.withColumn("n", F.row_number().over(once)).where("n = 1")
    rows = rows.withColumn("pass_no", F.row_number().over(Window.partitionBy("query_id").orderBy("facet", "item_no")))
    return rows.where(F.col("pass_no") <= most).select("query_id", "pass_no", "text")


def identity(source: Column, section: Column, chunk_type: Column, excerpt: Column) -> Column:
    return F.concat_ws("|", source, section, chunk_type, F.substring(F.sha1(F.encode(T.text(excerpt), "UTF-8")), 1, 12))


def appended(hits: DataFrame, more: DataFrame, most: int = 4) -> DataFrame:
    """hits with up to `most` second-pass hits per query that are new; both: query_id, identity, rank; more: pass_no."""
    new = more.join(hits.select("query_id", "identity"), ["query_id", "identity"], "left_anti")
    once = Window.partitionBy("query_id", "identity").orderBy("pass_no", "rank")
    new = new.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    new = new.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("pass_no", "rank"))).where(F.col("_n") <= most)
    last = hits.groupBy("query_id").agg(F.max("rank").alias("last"))
    new = new.join(last, "query_id", "left").withColumn("rank", F.col("_n") + F.coalesce("last", F.lit(0)))
    return hits.unionByName(new.select(*hits.columns))


def whole_sections(hits: DataFrame, chunks: DataFrame, most: int = 2, bonus: float = 12.0) -> DataFrame:
    """(query_id, source, section, chunk_id, score): for the first sections of a query's hits, the chunk that gives the text.

    hits: query_id, rank, source, section, score; chunks: chunk_id, source, section, chunk_type, parent_chars. Text
    chunks are taken before others, then the longest parent. A section that doesn't resolve isn't counted.
    """
    first = Window.partitionBy("query_id", "source", "section").orderBy("rank")
    asked = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("query_id", "source", "section", "rank", "score")
    best = Window.partitionBy("source", "section").orderBy((F.col("chunk_type") == "text").desc(), F.col("parent_chars").desc(), "chunk_id")
    own = chunks.join(asked.select("source", "section").distinct(), ["source", "section"], "left_semi")
    own = own.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("source", "section", "chunk_id")
    rows = asked.join(own, ["source", "section"]).withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return rows.where(F.col("_n") <= most).select("query_id", "source", "section", "chunk_id", (F.col("score") + bonus).alias("score"))


def answerable(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """queries with `answerable`: whether any hit exists."""
    have = hits.select("query_id").distinct().withColumn("answerable", F.lit(True))
    return queries.join(have, "query_id", "left").withColumn("answerable", F.coalesce("answerable", F.lit(False)))


def pack(hits: DataFrame, with_score: bool = False, tags: int = 18) -> DataFrame:
    """(query_id, evidence): numbered blocks of a query's hits, in rank order.

    hits: query_id, rank, title, source_label, section, chunk_type, metadata, score, excerpt, parent_excerpt.
    """
    names = [
        F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), T.tidy_label("title")), F.concat(F.lit("Source: "), "source_label"), F.concat(F.lit("Section: "), T.tidy_label("section")), F.concat(F.lit("Type: "), "chunk_type"),
        F.concat(F.lit("Tags: "), F.coalesce(F.nullif(F.array_join(F.slice("metadata", 1, tags), ", "), F.lit("")), F.lit("none"))), *([F.concat(F.lit("Score: "), F.format_number("score", 3))] if with_score else []), F.concat(F.lit("Excerpt: "), "excerpt"),
        F.when((F.col("parent_excerpt") != "") & (F.col("parent_excerpt") != F.col("excerpt")), F.concat(F.lit("Context: "), "parent_excerpt")),
    ]
    rows = hits.select("query_id", F.struct("rank", F.concat_ws("\n", *names).alias("block")).alias("b"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["block"]), "\n\n").alias("evidence"))


def trace(hits: DataFrame, tags: int = 24, chars: int = 420) -> DataFrame:
    """(query_id, trace): a JSON line of each query's hits for inspection. Scores, never negative, are rounded as SQL does, by their binary value."""
    row = F.struct("rank", (F.floor(F.col("score") * 1000 + 0.5) / 1000).alias("score"), "source_label", "section", "chunk_type", F.slice("metadata", 1, tags).alias("metadata"), F.array_sort("facets").alias("facets"), F.substring(T.collapse("excerpt"), 1, chars).alias("excerpt"))
    return hits.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("trace"))
