"""The near-duplicate stage of the pipeline against brute-force Jaccard similarity of five-word shingles."""

from __future__ import annotations

import random

import corpus_pipeline
from quarry.llm import simhash


def brute(texts: list[str | None]) -> list[int]:
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    return root


def near_copies() -> list[str | None]:
    """Texts, and copies with words replaced so that similarities lie around 0.8."""
    r = random.Random(8)
    texts: list[str | None] = [None, "", " ", "a b", "A  b", "a b c"]
    for size in (30, 120, 400):
        for _ in range(12):
            base = [f"w{r.randrange(3000)}" for _ in range(size)]
            texts.append(" ".join(base))
            for share in (0.005, 0.01, 0.02, 0.025, 0.03, 0.05):
                copy = list(base)
                for i in r.sample(range(size), max(1, round(share * size))):
                    copy[i] = f"x{r.randrange(3000)}"
                texts.append(" ".join(copy))
    r.shuffle(texts)
    return texts


def test_components_are_those_of_brute_force(spark):
    texts = near_copies()
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    want = brute(texts)
    assert len(set(want)) < len(texts)
    for block in (256, 2):
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, width=5, similarity=0.8, block=block).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_stage_keeps_one_of_each_group(spark):
    texts = near_copies()
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (0, texts[0])], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = [r.doc_id for r in stage(spark, docs, "").collect()]
    assert sorted(kept, key=lambda x: (x is not None, x)) == [None, *sorted(set(brute(texts)))]
    assert stage(spark, docs.limit(0), "").count() == 0
