"""Block maxima, dense blocks, vocabularies by joins and late fetches against plain models; what plans read."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import index as I
from quarry.operators import retrieve as R
from quarry.operators.dense import dense_topk
from quarry.plans import planner as P
from quarry.plans import vocabulary as W
from quarry.queries import retrieval
from quarry.sources.tables import fetched, kept

SF = "/root/testdata/sf0.001"


def test_block_topk_equals_all_scores(spark, tmp_path):
    r = random.Random(3)
    chunks = [(c, [f"t{min(int(r.expovariate(0.08)), 60)}" for _ in range(r.randint(0, 40))]) for c in range(400)]
    index = I.build(spark.createDataFrame(chunks, "chunk_id int, tokens array<string>"), f"file://{tmp_path}/index", salt_rows=50, block_rows=8)
    asked = spark.createDataFrame([(q, 0, f"t{t}") for q in range(15) for t in r.sample(range(63), 6)] + [(99, 0, "nowhere")], "query_id int, variant_no int, token string")
    whole = {tuple(x) for x in R.top(R.combined(R.bm25(asked, index)), 4).select("query_id", "chunk_id", "score", "rank").collect()}
    assert {tuple(x) for x in R.block_topk(asked, index, 4).select("query_id", "chunk_id", "score", "rank").collect()} == whole
    for ahead in (1.0, 0.3):
        read = R.reachable(asked, index, 4, seeds=4, ahead=ahead)
        assert read.agg(F.sum("n")).first()[0] < asked.join(index.tokens, "token").agg(F.sum("df")).first()[0]
        assert read.where("rest < 0").isEmpty()
    assert index.blocks.where("n > 8 or size(chunk_ids) <> n or array_max(parts) <> max_part").isEmpty()


@pytest.mark.parametrize("k", [1, 5])
def test_dense_topk_equals_brute_force(spark, k):
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(12, 8))
    v = centres[rng.integers(0, 12, 500)] + 0.1 * rng.normal(size=(500, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[8]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, []), (901, [1.0, 0.0]), (902, [0.6, 0.8])]
    table = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    asked = table.where("chunk_id % 9 = 0 or chunk_id > 899").select(F.col("chunk_id").alias("query_id"), "vector")
    got: dict[int, list] = {}
    for x in dense_topk(asked, table, k, pivots=10).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.chunk_id, x.dense))
    own = {i: np.array(x) for i, x in rows if x}
    want = {}
    for q in [i for i in own if i % 9 == 0 or i > 899]:
        found = sorted((-round(float(own[q] @ x), 6), i) for i, x in own.items() if len(x) == len(own[q]))
        want[q] = [(i, -s) for s, i in found if s < 0][:k]
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_a_large_vocabulary_matches_as_a_nested_loop(spark):
    """200,000 entries: a sample of them against all texts one by one."""
    r = random.Random(8)
    letters = "abcdeÀé中文12"
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    terms = [r.choice(["", "", "x-", "The ", "."]) + word(r.randint(1, 5)) + r.choice(["", "", "-2", "+", " b", ".."]) for _ in range(200_000)]
    texts = [(i, " ".join(word(r.randint(1, 6)).upper() if r.random() < 0.2 else word(r.randint(1, 6)) for _ in range(30)) + r.choice(["", " x-ab-2.", "\nthe ab"])) for i in range(60)] + [(900, None), (901, "")]
    entries = spark.range(200_000).select(F.lit("m").alias("module"), F.col("id").cast("int").alias("entry_no"), F.col("id").cast("string").alias("entry_id"))
    table = spark.createDataFrame([*enumerate(terms)], "n int, t string")
    entries = entries.join(table, F.col("entry_no") == F.col("n")).select("module", "entry_no", "entry_id", F.array("t", F.lit("")).alias("triggers"), F.array().cast("array<string>").alias("expansions"))
    queries = spark.createDataFrame(texts, "query_id int, text string")
    got = {(x.query_id, int(e)) for x in W.matched(queries, entries).collect() for e in x.entries}
    sample = set(r.sample(range(200_000), 1500)) | {e for _, e in r.sample(sorted(got), min(300, len(got)))}

    def fits(term: str, text: str | None) -> bool:
        if not term or not text:
            return False
        p = P.trigger_pattern(term)
        return bool(re.search(p, text, re.A) if p else term.lower() in text.lower())

    want = {(q, e) for q, text in texts for e in sample if fits(terms[e], text)}
    assert {(q, e) for q, e in got if e in sample} == want and len(want) > 200


def test_vocabulary_equals_the_compiled_one(spark):
    entries = [P.Entry("m", "one", ("The", "keit."), ("more", "words")), P.Entry("m", "two", ("x", "new york"), ("york",)), P.Entry("n", "none", ("zzz",))]
    rows = [(1, "the end"), (2, "Einsamkeit. New York"), (3, "then X-ray"), (4, None), (5, "axb")]
    queries = spark.createDataFrame(rows, "query_id int, text string")
    table = spark.createDataFrame([(e.module, i, e.entry_id, list(e.triggers), list(e.expansions)) for i, e in enumerate(entries)], "module string, entry_no int, entry_id string, triggers array<string>, expansions array<string>")
    want = {x.query_id: x.e or [] for x in queries.select("query_id", P.matched(F.col("text"), entries).alias("e")).collect()}
    more = {x.query_id: x.e or [] for x in queries.select("query_id", P.expansions(F.col("text"), (("zzzz", ("none",)),), entries).alias("e")).collect()}
    got = W.matched(queries, table).collect()
    assert {x.query_id: x.entries for x in got} == want | {4: []} and {x.query_id: x.expansions for x in got} == more | {4: []}


def test_rule_tables_fire_as_compiled_rules(spark):
    r = random.Random(2)
    piece = lambda: "".join(r.choice("abcAB ") for _ in range(r.randint(1, 4)))
    rows = [(n, "t", c, r.choice(["contains", "contains_ci"]), piece(), c == 3, str(n)) for n in range(40) for c in (1, 2, 2, 3) if c < 3 or n % 2]
    texts = spark.createDataFrame([(i, "".join(r.choice("abcAB ") for _ in range(40))) for i in range(50)] + [(99, None), (98, "")], "id int, text string")
    table = spark.createDataFrame([(n, c, k, t, neg) for n, _, c, k, t, neg, _ in rows], "rule_no int, clause_no int, kind string, term string, negate boolean")
    from quarry.operators.rules import Rules

    want = {(x.id, n) for x in texts.where("text is not null").select("id", Rules(rows).flags(F.col("text")).alias("f")).collect() for n in x.f}
    assert {tuple(x) for x in W.fired(texts, table).collect()} == want
    with pytest.raises(ValueError, match="negated"):
        W.fired(texts, spark.createDataFrame([(1, 1, "contains", "a", True)], table.schema))
    with pytest.raises(ValueError, match="keys"):
        W.fired(texts, spark.createDataFrame([(1, 1, "regex", "a", False)], table.schema))


def test_fetched_reads_ranges_only(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(5000).select(F.col("id").alias("k"), F.lit("x").alias("text")).repartitionByRange(10, "k").write.parquet(path)
    table = spark.read.parquet(path)
    ids = spark.createDataFrame([(3,), (4,), (4990,), (3,)], "k long")
    rows = fetched(table, ids, "k")
    assert sorted(r.k for r in rows.collect()) == [3, 4, 4990]
    assert "PushedFilters" in (plan := rows._jdf.queryExecution().toString()) and "LessThanOrEqual(k,4)" in plan
    assert fetched(table, ids.limit(0), "k").count() == 0
    names = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert [r.v for r in fetched(names, spark.createDataFrame([("b",)], "k string"), "k").collect()] == [2]


@pytest.mark.parametrize("name,most", [("r6_adjusted", 0), ("r7_best_per_key", 0), ("r9_balanced", 0), ("r10_fused", 0), ("r11_priority", 0), ("r13_coverage", 0), ("r14_second_pass", 0), ("r16_whole_sections", 0), ("r12_rerank", 1), ("r15_appended", 0), ("r19_pack", 1)])
def test_searches_read_no_texts(spark, name, most):
    """Scans of the documents' texts in a search's plan; r15's only one ends in a table of excerpts."""
    retrieval.index_of(spark, SF)
    plan = {q.__name__: q for q in retrieval.QUERIES}[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[[^\]]*\btext#", plan)) - len(re.findall(r"Relation \[item_id#[^\]]*\btext#", plan)) - len(re.findall(r"Relation \[query_id#[^\]]*\btext#", plan)) <= most


def test_an_index_follows_its_documents(spark, tmp_path):
    path, d = tmp_path / "documents.parquet", f"file://{tmp_path}"
    rows = lambda n: spark.range(n).select(F.col("id").alias("doc_id"), F.lit("one word").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    rows(3).write.parquet(f"file://{path}")
    assert retrieval.index_of(spark, d).stats.first().n == 3
    first = retrieval._BUILT[spark.sparkContext.applicationId, d]
    assert retrieval.index_of(spark, d).stats.first().n == 3 and retrieval._BUILT[spark.sparkContext.applicationId, d] == first
    rows(5).write.mode("overwrite").parquet(f"file://{path}")
    assert retrieval.index_of(spark, d).stats.first().n == 5
    assert kept(rows(2)).count() == 2
