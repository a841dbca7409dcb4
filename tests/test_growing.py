"""An index that grows, and a cache that is filled, against indexes and caches made anew."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import index as I
from quarry.operators import retrieve as R
from quarry.operators.growing import GrowingIndex
from quarry.sources import vectors

CHUNKS = "chunk_id long, tokens array<string>"


def words(r: random.Random) -> list[str]:
    return [f"t{min(int(r.expovariate(0.1)), 50)}" for _ in range(r.randint(0, 30))]


def rows_below(folder: str) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_changes_equal_an_index_made_anew(spark, tmp_path):
    r = random.Random(5)
    known = {c: words(r) for c in range(80)}
    grown = GrowingIndex(spark, f"file://{tmp_path}/grown")
    assert grown.stats().first().n == 0
    grown.add(spark.createDataFrame([*known.items()], CHUNKS))

    def delete(ids):
        grown.delete(spark.createDataFrame([(i,) for i in ids], "chunk_id long"))
        for i in ids:
            known.pop(i, None)

    def add(new):
        grown.add(spark.createDataFrame([*new.items()], CHUNKS))
        known.update(new)

    asked = spark.createDataFrame([(q, 0, f"t{t}") for q in range(8) for t in r.sample(range(52), 5)], "query_id int, variant_no int, token string")

    def same(n: int) -> None:
        folder = f"file://{tmp_path}/anew{n}"
        whole = I.build(spark.createDataFrame([*known.items()], CHUNKS), folder)
        want = {(x.query_id, x.chunk_id): round(x.bm25, 9) for x in R.bm25(asked, whole).collect()}
        assert {(x.query_id, x.chunk_id): round(x.bm25, 9) for x in grown.bm25(asked).collect()} == want
        a, b = grown.stats().first(), whole.stats.first()
        assert a.n == b.n and a.avg_len == pytest.approx(b.avg_len)

    delete([3, 4, 5, 999])
    add({200: words(r), 4: words(r)})  # an id that was deleted comes again
    same(0)
    delete([4, 4])
    delete([70])
    same(1)
    grown.merge()
    add({300: words(r)})
    same(2)
    assert {p.split("segment")[0] for p in os.listdir(tmp_path / "grown")} >= {"versions"} and not [p for p in os.listdir(tmp_path / "grown") if p.startswith("tombstones")]


def test_a_change_writes_its_own_size(spark, tmp_path):
    r = random.Random(9)
    make = lambda ids: spark.createDataFrame([(c, [f"w{r.randint(0, 3000)}" for _ in range(60)]) for c in ids], CHUNKS).coalesce(1)
    grown = GrowingIndex(spark, f"file://{tmp_path}/g")
    first = f"{tmp_path}/g/{grown.add(make(range(3000)))}"
    one = f"{tmp_path}/g/{grown.add(make(range(3000, 3030)))}"
    gone = f"{tmp_path}/g/{grown.delete(spark.range(30).select(F.col('id').alias('chunk_id')))}"
    whole = rows_below(first)
    assert rows_below(one) < 0.06 * whole and rows_below(gone) < 0.06 * whole  # a hundredth, and the files' own heads


def test_a_failed_change_leaves_the_index(spark, tmp_path):
    grown = GrowingIndex(spark, f"file://{tmp_path}/g")
    grown.add(spark.createDataFrame([(1, ["a"])], CHUNKS))
    bad = spark.createDataFrame([(2, ["b"])], CHUNKS).withColumn("tokens", F.when(F.raise_error(F.lit("no")).isNull(), F.col("tokens")))
    with pytest.raises(Exception, match="no"):
        grown.add(bad)
    assert grown.stats().first().n == 1
    grown.add(spark.createDataFrame([(3, ["a", "c"])], CHUNKS))
    assert {x.token: x.df for x in grown.frequencies().collect()} == {"a": 2, "c": 1}


def test_a_cache_is_filled_once(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    keyed = spark.createDataFrame([("a", "xx"), ("b", "y"), ("a", "xx"), ("z", "")], "key string, dense_text string")
    embed = lambda texts: [[float(len(t)), 0.0] for t in texts]
    found = {r.key: list(r["values"]) for r in vectors.fill_cache(keyed, path, embed).collect()}
    assert found == {"a": [1.0, 0.0], "b": [1.0, 0.0]}

    def only_empty(texts):
        if any(texts):
            raise ValueError("asked again")
        return [[0.0] for _ in texts]

    assert vectors.fill_cache(keyed, path, only_empty).count() == 2
    more = vectors.fill_cache(keyed.union(spark.createDataFrame([("c", "new")], keyed.schema)), path, embed)
    assert {r.key for r in more.collect()} == {"a", "b", "c"}
