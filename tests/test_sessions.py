"""Session state in batch and as a stream, verdicts, webhook bodies."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quarry.operators import sessions as C
from quarry.operators import verdicts as V
from quarry.operators.rules import Rules, all_of, any_of
from quarry.sources import tables, webhook
from quarry.sources.vectors import read_cache
from quarry.streaming.sessions import session_contexts

TURNS = "session_key string, seq long, role string, text string, ts long"


def test_live_context(spark):
    rows = [("a", i, "user", str(i), 1000 + i) for i in range(12)] + [("b", 1, "system", "s", 5000), ("b", 2, "user", "none", None), ("c", 1, "user", "edge", 100), ("c", 2, "user", "old", 99)]
    got = C.live(spark.createDataFrame(rows, TURNS), now=100 + C.TTL).collect()
    assert {(r.session_key, r.seq) for r in got} == {("a", i) for i in range(4, 12)} | {("c", 1)}


def test_reset_and_memory(spark):
    rows = spark.createDataFrame([("a", 1, "user", "x", 1), ("a", 2, "user", "reset", 2), ("a", 3, "user", "y", 3), ("b", 1, "user", "z", 1)], TURNS)
    assert {(r.session_key, r.seq) for r in C.since_reset(rows, F.col("text") == "reset").collect()} == {("a", 3), ("b", 1)}
    commands = spark.createDataFrame([("a", 1, "Ann", False), ("a", 2, "Bob", False), ("b", 1, "Cid", False), ("b", 2, None, True)], "session_key string, seq long, name string, forget boolean")
    assert [(r.session_key, r.display_name) for r in C.user_memory(commands).collect()] == [("a", "Bob")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", i, "user" if i % 2 else "assistant", f"t{i}", i * 10_000, False) for i in range(1, 12)] + [("b", 1, "user", "x", 5, False), ("b", 2, "user", "reset", 6, True), ("b", 3, "system", "no", 7, False)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, TURNS + ", reset boolean").write.parquet(source)
    stream = session_contexts(spark.readStream.schema(TURNS + ", reset boolean").parquet(source), most=4)
    query = stream.writeStream.format("memory").queryName("contexts").trigger(once=True).option("checkpointLocation", str(tmp_path / "marks")).start()
    query.awaitTermination()
    got = {(r.session_key, r.seq): r.context_turns for r in spark.table("contexts").collect()}
    turns = spark.createDataFrame([r[:5] for r in rows if r[0] == "a"], TURNS)
    want = {("a", i): C.live(turns.where(F.col("seq") <= i), i * 10_000, most=4).count() for i in (1, 4, 11)}
    assert {k: got[k] for k in want} == want and [got["b", i] for i in (1, 2, 3)] == [1, 0, 0]


def test_webhook(spark):
    event = lambda kind, message, **source: {"type": kind, "message": message, "source": source, "replyToken": "r"}
    body = json.dumps({"events": [event("message", {"type": "text", "text": " hi "}, userId="u", groupId="g"), event("message", {"type": "image"}, userId="u"), event("follow", {}, userId="u"), event("message", {"type": "text", "text": " "}, userId="u"), event("message", {"type": "text", "text": "lost"})]})
    rows = webhook.messages(spark.createDataFrame([(1, body), (2, "{"), (3, None)], "id int, body string"), scope="chat_user").collect()
    assert [(r.id, r.event_no, r.session_key, r.target, r.text) for r in rows] == [(1, 0, "chat_user:g:u", "g", "hi")]


def test_verdicts(spark):
    candidates = spark.createDataFrame([(q, r) for q in (1, 2, 3, 4) for r in range(1, 8)], "query_id int, rank int")
    raw = spark.createDataFrame([(1, 'x {"selected_ids": [3, 9, "1", 3, "z", 0, 2, 4, 5, 6], "answerable": "NO", "coverage_gaps": ["a", "b"]} y'), (2, "no json"), (3, '{"selected_ids": "all"}')], "query_id int, raw string")
    got: dict = {}
    for r in V.selected(candidates, raw).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.rank)
    assert got == {1: [3, 1, 2, 4, 5], 2: [1, 2, 3, 4, 5], 3: [1, 2, 3, 4, 5], 4: [1, 2, 3, 4, 5]}
    assert [(r.answerable, r.gaps) for r in V.parsed(raw).orderBy("query_id").collect()] == [(False, "a；b"), (True, ""), (True, "")]


def test_rules(spark):
    rules = Rules([*all_of(2, "t", "both", "contains", ("a", "b"), ("c",)), *any_of(1, "t", "year $1", "regex", "(20[0-9]{2})"), (3, "t", 1, "contains_ci", "X", True, "no x")])
    rows = spark.createDataFrame([("a c 2024",), ("b x",), ("",)], "t string").select(rules.values(F.col("t")).alias("v"), rules.first(F.col("t"), "none").alias("f")).collect()
    assert [(r.v, r.f) for r in rows] == [(["year 2024", "both", "no x"], "year 2024"), ([], "none"), (["no x"], "no x")]


def test_upsert_and_cache(spark, tmp_path):
    old, new = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, at int, v string"), spark.createDataFrame([("a", 1, "z"), ("b", 4, "w"), ("c", 1, "n")], "k string, at int, v string")
    assert {(r.k, r.v) for r in tables.upserted(old, new, "k", "at").collect()} == {("a", "z"), ("b", "y"), ("c", "n")}
    (tmp_path / "cache.jsonl").write_text('{"key": "a", "values": [1, 0]}\nbad\n{"key": "z", "values": [0, 0]}\n{"key": "a", "values": [0, 2]}\n')
    assert [(r.key, r["values"]) for r in read_cache((spark, str(tmp_path / "cache.jsonl"))).collect()] == [("a", [0.0, 1.0])]


def test_upserts_from_a_stream(spark, tmp_path):
    """Batches of a stream end as the last row of each key; a repeated batch changes nothing."""
    from quarry.sources import tables

    rows = [("a", 1, "x"), ("b", 1, "y"), ("a", 3, "z"), ("a", 2, "late"), ("c", 1, "w"), ("b", 1, "again")]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "k string, seq int, v string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    folder = f"file://{tmp_path}/table"
    stream = spark.readStream.schema("k string, seq int, v string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = stream.writeStream.foreachBatch(lambda new, batch: tables.upsert_batch(new, batch, folder, "k", "seq")).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.k: (r.seq, r.v) for r in tables.read_latest(spark, folder).collect()}
    assert got.keys() == {"a", "b", "c"} and got["a"] == (3, "z") and got["c"] == (1, "w") and got["b"][0] == 1
    last = tables._versions(spark, folder)
    assert len(last) == 2
    tables.upsert_batch(tables.read_latest(spark, folder).limit(0), last[-1], folder, "k", "seq")
    assert {r.k for r in tables.read_latest(spark, folder).collect()} <= got.keys() and tables.read_latest(spark, f"{folder}x") is None
