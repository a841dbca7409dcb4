"""Registered queries of the retrieval jobs, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.queries import chunking, conversing, indexing, planning, retrieval, sourcing, tagging, texts

MODULES = (sourcing, texts, chunking, tagging, indexing, planning, retrieval, conversing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for m in MODULES for q in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
