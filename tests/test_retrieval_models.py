"""Pruning, balance, fusion, re-rank and excerpts against plain models on random cases."""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from quarry.functions.excerpt import excerpt
from quarry.operators import coverage as V
from quarry.operators import index as I
from quarry.operators import retrieve as R


def test_candidates(spark):
    r = random.Random(1)
    posts = {(f"t{t}", c) for t in range(25) for c in range(400) if r.random() < [0.02, 0.1, 0.3, 0.9][t % 4]}
    df: dict[str, int] = {}
    for t, _ in posts:
        df[t] = df.get(t, 0) + 1
    queries = {q: r.sample([f"t{t}" for t in range(30)], r.randint(1, 8)) for q in range(40)} | {99: ["t3"]}
    want = set()
    for q, tokens in queries.items():
        usable = sorted((t for t in tokens if t in df and df[t] < max(400 * 0.85, 1)), key=lambda t: (df[t], -len(t), t))
        found: set[int] = set()
        for n, t in enumerate(usable):
            if n and (n >= 72 or len(found) >= 60):
                break
            found |= {c for x, c in posts if x == t}
        want |= {(q, c) for c in found or range(400)}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    asked = frame([(q, 0, t) for q, ts in queries.items() for t in ts], "query_id int, variant_no int, token string")
    got = R.candidates(asked, frame([*posts], "token string, chunk_id int"), frame([(400, 1.0)], "n long, avg_len double"), frame([*df.items()], "token string, df int"), target=60, chunks=frame([(c,) for c in range(400)], "chunk_id int"))
    assert {(x.query_id, x.chunk_id) for x in got.collect()} == want


def balanced_model(hits: list[tuple], limit: int, quota: int) -> list[int]:
    hits = sorted(hits, key=lambda h: (-h[2], h[0]))
    if len(hits) <= limit:
        return [h[0] for h in hits]
    sources: dict[str, list] = {}
    for h in hits:
        sources.setdefault(h[1], []).append(h)
    chosen = [h for own in sources.values() for h in own[:quota]][:limit]
    chosen += [h for h in hits if h not in chosen][: limit - len(chosen)]
    return [h[0] for h in sorted(chosen, key=lambda h: -h[2])]


def test_balanced(spark):
    r = random.Random(2)
    cases = {q: [(c, r.choice("aaaabc"), round(r.random(), 3)) for c in range(r.randint(1, 30))] for q in range(60)}
    rows = [(q, 0, c, s, x) for q, hits in cases.items() for c, s, x in hits]
    got: dict[int, list] = {}
    for x in R.balanced(spark.createDataFrame(rows, "query_id int, variant_no int, chunk_id int, source_label string, score double"), 7).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.chunk_id)
    assert got == {q: balanced_model(hits, 7, 2) for q, hits in cases.items()}


def test_fused_keeps_the_best_and_the_first_of_equals(spark):
    hits = spark.createDataFrame([(1, 0, 10, "a", 2.0, 1), (1, 1, 11, "a", 2.0, 1), (1, 1, 12, "b", 1.0, 2)], "query_id int, variant_no int, chunk_id int, hit_key string, score double, rank int")
    variants = spark.createDataFrame([(1, 0, 1.0, 35.0), (1, 1, 1.0, 35.0)], "query_id int, variant_no int, weight double, bonus double")
    assert {(r.chunk_id, r.score) for r in R.fused(hits, variants).collect()} == {(10, 19.5), (12, round(1 + 35 / 3, 6))}


def picked_model(rows: list[dict], required: set, limit: int) -> list[int]:
    """The re-rank's choices one by one, each value summed from its parts."""
    w, top, chosen = V.Weights(), max(r["score"] for r in rows), []
    while len(chosen) < min(limit, len(rows)):
        seen = [rows[k] for k in chosen]
        covered = {f for r in seen for f in r["facets"]}

        def value(r: dict, seen=seen, covered=covered) -> float:
            fresh, own = set(r["facets"]) - covered, set(r["facets"])
            parts = [r["score"] / top, w.target * len(fresh & required)]
            if required:
                parts += [w.general * min(len(fresh), w.general_most), -w.each_missing * len(required - own), 0 if own & required else -w.no_target]
            else:
                parts.append(w.general_free * min(len(fresh), w.general_free_most))
            if seen:
                words = set(r["excerpt"].split())
                alike = any(len(words & set(x["excerpt"].split())) / len(words | set(x["excerpt"].split())) > w.similarity for x in seen)
                parts += [w.new_source * (r["source"] not in {x["source"] for x in seen}), w.new_section * (r["section"] not in {x["section"] for x in seen}), -w.same_place * any(r["source"] == x["source"] and r["section"] == x["section"] for x in seen), -w.similar * alike]
            return max(-1.0, round(sum(parts), 12))

        chosen.append(max((k for k in range(len(rows)) if k not in chosen), key=lambda k: (value(rows[k]), -k)))
    return chosen


def test_rerank_against_a_model(spark):
    r = random.Random(6)
    cases, rows = {}, []
    for q in range(25):
        own = [{"score": round(20 - c + r.random(), 3), "source": r.choice("ab"), "section": r.choice("xyz"), "facets": r.sample(["f", "g", "h", "i"], r.randint(0, 3)), "excerpt": " ".join(r.sample(["one", "two", "three", "four"], 3))} for c in range(12)]
        own.sort(key=lambda x: -x["score"])
        cases[q] = (own, set(r.sample(["f", "g", "zz"], r.randint(0, 2))))
        rows += [(q, c, c, x["score"], x["source"], x["source"], x["section"], "text", x["excerpt"], x["facets"], sorted(cases[q][1]), "") for c, x in enumerate(own)]
    table = spark.createDataFrame(rows, "query_id int, chunk_id int, rank int, score double, source string, source_label string, section string, chunk_type string, excerpt string, facets array<string>, required array<string>, preferred string")
    got: dict[int, list] = {}
    for x in V.rerank(table, 5).orderBy("query_id", "place").collect():
        got.setdefault(x.query_id, []).append(x.chunk_id)
    assert got == {q: picked_model(own, required, 5) for q, (own, required) in cases.items()}


def test_rerank(spark):
    rows = [(1, c, c, 10.0 - c, f"s{c % 2}", f"s{c % 2}", f"sec{c % 3}", "text", f"word{c} other{c}", ["x"] if c != 4 else ["y"], ["y"], "") for c in range(6)]
    table = spark.createDataFrame(rows, "query_id int, chunk_id int, rank int, score double, source string, source_label string, section string, chunk_type string, excerpt string, facets array<string>, required array<string>, preferred string")
    got = [r.chunk_id for r in V.rerank(table, 3).orderBy("place").collect()]
    assert got[0] == 4 and len(got) == 3  # only chunk 4 has the required facet
    first = V.rerank(table.withColumn("preferred", F.lit("s1")), 1).first().chunk_id
    assert first == 1 or first % 2 == 1


def excerpt_model(text: str | None, tokens: list[str] | None, chars: int) -> str:
    flat, asked = " ".join((text or "").split()), [t.lower() for t in tokens or [] if t]
    if len(flat) <= chars:
        return flat
    parts = re.split(r"(?<=[.!?]) ", flat)
    points = [sum(t in p.lower() for t in asked) for p in parts]
    if len(parts) > 1 and max(points):
        best = points.index(max(points))
        order = [i for k in range(1, len(parts)) for i in (best - k, best + k) if 0 <= i < len(parts)]
        chosen, size, seen = [best], len(parts[best]), 0
        for i in order:
            if size >= chars:
                break
            seen += 1
            if size + 1 + len(parts[i]) <= chars:
                chosen.append(i)
                size += 1 + len(parts[i])
        rest = order[seen:]
        return "..." * any(i < best for i in rest) + " ".join(parts[i] for i in sorted(chosen)) + "..." * any(i > best for i in rest)
    first = min([flat.lower().find(t) for t in asked if t in flat.lower()], default=0)
    end = min(len(flat), max(0, first - chars // 3) + chars)
    start = max(0, end - chars)
    return "..." * (start > 0) + flat[start:end].strip() + "..." * (end < len(flat))


def test_excerpts_against_a_model(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 6)))
    rows = [(i, " ".join(word() + r.choice(["", "", "", ".", "!", "?"]) for _ in range(r.randint(0, 60))), [word() for _ in range(r.randint(0, 4))]) for i in range(200)]
    rows += [(900, None, None), (901, "", ["a"]), (902, "x" * 50 + " needle " + "y" * 50, ["needle"]), (903, "No sentence " * 20, ["zzz", ""]), (904, "  a  b ", None)]
    table = spark.createDataFrame(rows, "id int, text string, tokens array<string>")
    for chars in (24, 60):
        got = {x.id: x.e for x in table.select("id", excerpt(F.col("text"), F.col("tokens"), chars).alias("e")).collect()}
        assert got == {i: excerpt_model(t, q, chars) for i, t, q in rows}


def test_pair_scores_equal_the_sums_over_posting_lists(spark, tmp_path):
    """The same BM25 by the forward table as by posting lists cut into pieces, for the pairs asked for."""
    r = random.Random(12)
    chunks = [(c, [f"t{min(int(r.expovariate(0.15)), 30)}" for _ in range(r.randint(0, 25))]) for c in range(150)]
    index = I.build(spark.createDataFrame(chunks, "chunk_id int, tokens array<string>"), f"file://{tmp_path}/index", salt_rows=20)
    assert index.tokens.agg(F.max("n_salts")).first()[0] > 3 and index.stats.first().n == 150
    asked = spark.createDataFrame([(q, 0, f"t{t}") for q in range(12) for t in r.sample(range(33), 5)], "query_id int, variant_no int, token string")
    whole = {(x.query_id, x.chunk_id): x.bm25 for x in R.bm25(asked, index).collect()}
    among = spark.createDataFrame([(q, 0, c) for q in range(12) for c in range(150) if r.random() < 0.4], "query_id int, variant_no int, chunk_id int")
    got = {(x.query_id, x.chunk_id): x.bm25 for x in R.pair_scores(among, R.query_side(asked), index.forward, "bm25").collect()}
    few = R.pair_scores(among, R.query_side(asked), index.forward, "bm25", most=5)
    assert {(x.query_id, x.chunk_id): x.bm25 for x in few.collect()} == got
    assert got.keys() == {(x.query_id, x.chunk_id) for x in among.collect()} & whole.keys()
    assert all(abs(v - whole[k]) < 1e-9 for k, v in got.items())
    n, texts, mine_of = 150, dict(chunks), {}
    avg = sum(len(t) for _, t in chunks) / n
    for x in asked.collect():
        mine_of.setdefault(x.query_id, set()).add(x.token)
    for q, c in whole:
        own, mine, want = texts[c], mine_of[q], 0.0
        for t in mine & set(own):
            df, tf = sum(t in x for _, x in chunks), own.count(t)
            want += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.28 + 0.72 * len(own) / avg))
        assert abs(want - whole[q, c]) < 1e-9
    assert not (tmp_path / "index" / "counted").exists()


def test_limits():
    assert R.answer_limits() == R.Limits(3, 520) and R.answer_limits(True) == R.Limits(5, 900)
    assert R.answer_limits(True, R.Limits(9, 100)) == R.Limits(9, 900)
