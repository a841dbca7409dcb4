"""Conversations as a stateful processor, against the batch functions on the same turns in several batch splits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.operators import sessions as C
from quarry.streaming import conversations as S

TURNS = "session_key string, seq long, role string, text string, ts long"


def contexts(spark, tmp_path, parts, begin=None, **how):
    S.use_rocksdb(spark)
    schema = TURNS + ", reset boolean"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i:02d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = S.live_contexts(stream, begin, late="3650 days", **how)
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return {(r.session_key, r.seq): (r.context_turns, r.context) for r in spark.read.parquet(f"{tmp_path}/out").collect()}


@pytest.mark.parametrize("split", [1, 2, 5])
def test_contexts_equal_batch_in_any_split(spark, tmp_path, split):
    rows = [(k, i, "user" if i % 2 else "assistant", f"{k}{i}", 1000 + i * step, False) for k, step in (("a", 10_000), ("b", 30_000), ("c", 1)) for i in range(1, 11)]
    rows += [("a", 11, "system", "no", 200_000, False), ("d", 1, "user", "x", None, False)]
    rows.sort(key=lambda r: r[1])
    size = -(-len(rows) // split)
    got = contexts(spark, tmp_path, [rows[i : i + size] for i in range(0, len(rows), size)], most=4)
    turns = spark.createDataFrame([r[:5] for r in rows], TURNS)
    for key, seq, ts in [("a", 1, 11_000), ("a", 7, 71_000), ("b", 3, 91_000), ("c", 10, 1010)]:
        want = C.live(turns.where((F.col("session_key") == key) & (F.col("seq") <= seq)), ts, most=4).orderBy("seq").collect()
        assert got[key, seq] == (len(want), "\n".join(f"- {r.role}: {r.text}" for r in want))
    assert ("d", 1) not in got and len(got) == 31


def test_contexts_begin_with_a_batch_table(spark, tmp_path):
    begin = spark.createDataFrame([("a", i, "user", f"old{i}", 100 + i) for i in range(6)] + [("z", 1, "user", "other", 5)], TURNS)
    got = contexts(spark, tmp_path, [[("a", 10, "user", "new", 200, False)], [("a", 11, "user", "reset", 201, True)], [("a", 12, "user", "after", 202, False)]], begin, most=3)
    assert got["a", 10] == (3, "- user: old4\n- user: old5\n- user: new") and got["a", 11] == (0, "") and got["a", 12] == (1, "- user: after")


def test_idle_sessions_go_by_event_time(spark, tmp_path):
    """Each batch's watermark is the newest time before it: a's state has gone when it speaks again, and its context is the same."""
    S.use_rocksdb(spark)
    schema = TURNS + ", reset boolean"
    for i, row in enumerate([("a", 1, "user", "one", 1000, False), ("b", 1, "user", "later", 500_000, False), ("b", 2, "user", "later", 500_001, False), ("a", 2, "user", "two", 500_002, False)]):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i:02d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = S.live_contexts(stream, late="0 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {(r.session_key, r.seq): r.context_turns for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 1): 1, ("b", 1): 1, ("b", 2): 2, ("a", 2): 1}
    state = spark.read.format("statestore").option("path", f"{tmp_path}/marks").option("stateVarName", "turns").load()
    assert {r.key.session_key for r in state.select("key").collect()} <= {"a", "b"} and state.where("key.session_key = 'a'").count() == 1
