"""Tables in a database: Derby, whose jars come with Spark. (Its dialect there sends null strings as CLOB, so texts are none here.)"""

from __future__ import annotations

import pytest

from quarry.sources import tables

ROWS = "k string, seq bigint, v string"
TYPES = "k VARCHAR(100), seq BIGINT, v VARCHAR(100)"


@pytest.fixture
def url(tmp_path):
    return f"jdbc:derby:{tmp_path}/db;create=true"


def test_written_tables_come_back_in_ranges(spark, url):
    rows = spark.createDataFrame([(f"k{i}", i if i % 50 else None, f"v{i}") for i in range(500)], ROWS)
    tables.write_table(rows, url, "hits", createTableColumnTypes=TYPES)
    tables.write_table(rows.limit(2), url, "hits")
    whole = tables.read_table(spark, url, "hits")
    assert whole.count() == 502
    parts = tables.read_partitioned(spark, url, "hits", "seq", 4)
    assert parts.rdd.getNumPartitions() == 4 and sorted(map(tuple, parts.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert all(len(p) < 400 for p in parts.rdd.glom().collect())
    tables.write_table(rows.limit(0), url, "no_hits", createTableColumnTypes=TYPES)
    assert tables.read_partitioned(spark, url, "no_hits", "seq", 4).count() == 0


def test_merges_by_key_are_idempotent(spark, url):
    frame = lambda *rows: spark.createDataFrame([*rows], ROWS)
    got = lambda: {(r.k, r.seq, r.v) for r in tables.read_table(spark, url, "sessions").collect()}
    merge = lambda rows, batch: tables.merge_batch(rows, batch, url, "sessions", "k", "seq", TYPES)
    first, second = frame(("a", 1, "x"), ("b", 5, "y"), ("a", 2, "x2")), frame(("b", 4, "late"), ("a", 2, "tie"), ("c", 1, "n"))
    merge(first, 0)
    assert got() == {("a", 2, "x2"), ("b", 5, "y")}
    merge(second, 1)
    want = {("a", 2, "tie"), ("b", 5, "y"), ("c", 1, "n")}
    assert got() == want
    merge(first, 0)
    merge(second, 1)
    assert got() == want


def test_a_merge_that_fails_changes_nothing(spark, url):
    rows = spark.createDataFrame([("a", 1, "x")], ROWS)
    tables.merge_batch(rows, 0, url, "sessions", "k", "seq", TYPES)
    with pytest.raises(Exception, match="(?i)no_such|syntax|exist"):
        tables._run(spark, url, 'update sessions set "v" = \'z\'', "insert into no_such values (1)")
    assert tables.read_table(spark, url, "sessions").first().v == "x"


def test_a_stream_ends_in_a_database(spark, url, tmp_path):
    for i, row in enumerate([("a", 1, "x"), ("b", 1, "y"), ("a", 3, "z"), ("a", 2, "late")]):
        spark.createDataFrame([row], ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = stream.writeStream.foreachBatch(lambda new, batch: tables.merge_batch(new, batch, url, "sessions", "k", "seq", TYPES)).option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {(r.k, r.seq, r.v) for r in tables.read_table(spark, url, "sessions").collect()} == {("a", 3, "z"), ("b", 1, "y")}
