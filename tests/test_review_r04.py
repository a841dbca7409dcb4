"""Cases of the fourth review."""

from __future__ import annotations

import json
import math
import os
import random

import duckdb
from pyspark.sql import functions as F

from quarry.operators import coverage as V
from quarry.operators import index as I
from quarry.operators import retrieve as R
from quarry.operators import scan as S
from quarry.operators.dense import dense_topk
from quarry.plans import vocabulary as W
from quarry.queries import indexing, retrieval


def test_unit_vectors_keep_the_sign_of_what_rounds_to_zero(spark, tmp_path):
    rows = [(1, [0.6, -0.000004, 0.8]), (2, [-1.0, 0.0, -0.0]), (3, [3.0, -4.0, 0.000001])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.unit for r in indexing.i8_unit_vectors(spark, f"file://{tmp_path}").collect()}
    assert got == {1: "0.60000 -0.00000 0.80000", 2: "-1.00000 0.00000 -0.00000", 3: "0.60000 -0.80000 0.00000"}


def test_a_term_that_ends_a_line_is_no_plain_word(spark):
    """`abc` and a line end must occur as they are; as a word the term would want another character behind it."""
    queries = spark.createDataFrame([(1, "xabc\nd"), (2, "abc d"), (3, "ABC\n"), (4, "abc\n\nd")], "query_id int, text string")
    entries = spark.createDataFrame([("m", 1, "one", ["abc\n"], ["more"])], "module string, entry_no int, entry_id string, triggers array<string>, expansions array<string>")
    assert {r.query_id: r.entries for r in W.matched(queries, entries).collect()} == {1: ["one"], 2: [], 3: ["one"], 4: ["one"]}


def test_dense_ties_after_rounding_go_to_the_smaller_id(spark):
    """Nearly equal vectors: the cosines differ in the ninth digit only, the largest ids being nearest."""
    rows = [(0, [1.0, 0.0])] + [(i, [math.cos(a), math.sin(a)]) for i in range(1, 40) for a in [0.5 - i * 1e-9]]
    table = spark.createDataFrame(rows, "chunk_id long, vector array<double>").coalesce(1)
    asked = table.where("chunk_id = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    got = dense_topk(asked, table, 4, pivots=2).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [0, 1, 2, 3] and len({r.dense for r in got}) == 2


def test_rule_tables_in_blocks_shuffle_no_pairs(spark):
    """Short, long and repeated terms, in one block and in several, against rules judged one by one; a plan without an exchange."""
    r = random.Random(5)
    piece = lambda: "".join(r.choice("abA") for _ in range(r.randint(1, 11)))
    rows = [(n, c, r.choice(["contains", "contains_ci"]), piece(), c == 3) for n in range(60) for c in (1, 2, 2, 3) if c < 3 or n % 3] + [(70, 1, "contains", "", False), (70, 2, "contains", "ab", None)]
    texts = spark.createDataFrame([(i, "".join(r.choice("abA") for _ in range(60))) for i in range(50)] + [(99, None), (98, "")], "id int, text string")
    rules = spark.createDataFrame(rows, "rule_no int, clause_no int, kind string, term string, negate boolean")

    def fires(text: str, n: int) -> bool:
        clauses: dict = {}
        for m, c, kind, term, negate in rows:
            if m == n and term:
                clauses.setdefault((c, bool(negate)), []).append(term in text if kind == "contains" else term.lower() in text.lower())
        return all(any(hits) != negate for (_, negate), hits in clauses.items())

    want = {x.id: own for x in texts.where("text is not null").collect() if (own := [n for n in sorted({m[0] for m in rows}) if fires(x.text, n)])}
    for most in (1000, 40):
        assert {x.id: x.rules for x in W.fired_lists(texts, rules, most).collect()} == want and len(want) > 40
    assert "Exchange" not in W.fired_lists(texts, rules)._jdf.queryExecution().executedPlan().toString()


def test_scans_find_what_posting_lists_do(spark, tmp_path):
    """Pairs, scores, and the best of each hit by scans, in one block of queries and in several, against posting lists."""
    r = random.Random(12)
    chunks = [(c, [f"t{min(int(r.expovariate(0.15)), 30)}" for _ in range(r.randint(0, 25))], f"h{c % 40}") for c in range(300)]
    table = spark.createDataFrame(chunks, "chunk_id long, tokens array<string>, hit_key string").repartition(3)
    index = I.build(table, f"file://{tmp_path}/lists")
    own = S.build(table, f"file://{tmp_path}/own", F.xxhash64("hit_key"), ["hit_key"])
    asked = spark.createDataFrame([(q, 0, f"t{t}") for q in range(12) for t in r.sample(range(33), 5)] + [(99, 0, "nowhere")], "query_id long, variant_no long, token string")
    among = R.candidates(asked, index.postings, index.stats, index.tokens.select("token", "df", "n_salts"), target=60)
    scored = R.combined(R.pair_scores(among, R.query_side(asked), index.forward, "bm25"))
    rows = lambda x, *c: {tuple(round(v, 5) if isinstance(v, float) else v for v in y) for y in x.select("query_id", "chunk_id", "score", *c).collect()}
    want = rows(scored)
    assert len(want) > 600 and rows(R.combined(R.bm25(asked, index))) == rows(S.search(asked, own, pruned=False)) > want
    best = R.top(R.best_per_key(scored.join(table.select("chunk_id", "hit_key"), "chunk_id")), 7)
    for most in (4096, 5):
        assert rows(S.search(asked, own, target=60, most=most)) == want
        found = S.search(asked, own, top=7, by_hit=True, target=60, most=most)
        assert rows(R.top(R.best_per_key(found, "hit"), 7), "rank") == rows(best, "rank")
    assert "Exchange" not in S.search(asked, own, shown=["hit_key"])._jdf.queryExecution().executedPlan().toString()


def test_searches_build_no_posting_lists(spark, tmp_path):
    """Below the folder of r1 are each chunk's own tokens, frequencies and statistics: no lists, blocks or vectors."""
    path, d = f"{tmp_path}/documents.parquet", f"file://{tmp_path}"
    spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("word and w"), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source")).write.parquet(f"file://{path}")
    spark.createDataFrame([(1, "and w3 w4")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = retrieval.r1_candidates(spark, d)
    assert {x.chunk_id for x in rows.collect()} == {3, 4} and "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    folder = retrieval._BUILT[spark.sparkContext.applicationId, d][1].removeprefix("file:").removeprefix("//")
    assert sorted(x for x in os.listdir(folder) if not x.startswith(".")) == ["own", "stats", "tokens"]


def test_trace_scores_round_as_sql(spark):
    """0.5005 lies below its half in binary: SQL gives 0.5, rounding of its decimal digits 0.501."""
    scores = [0.5005, 0.5015, 61.0005, 12.3456]
    hits = spark.createDataFrame([(1, i, x, "s", "en", "text", ["m"], ["f"], "words") for i, x in enumerate(scores)], "query_id long, rank int, score double, source_label string, section string, chunk_type string, metadata array<string>, facets array<string>, excerpt string")
    got = [x["score"] for x in json.loads(V.trace(hits).first().trace)]
    assert got == [duckdb.execute("select round(?::double, 3)", [x]).fetchone()[0] for x in scores]
