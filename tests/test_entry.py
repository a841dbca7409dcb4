"""The entry module: names, columns, and the flagship query."""

from __future__ import annotations

import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 90
    assert all(callable(q) for q in queries.values())


def test_flagship(spark):
    rows = entry.entry(spark)
    assert set(rows.columns) == {"query_id", "chunk_id", "score", "rank"} and rows.count() > 0
