"""What several operators need: words of a text, written intermediate tables, and a map over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.sources.shared import shared_folder

#: Rows that a Python worker holds the results of at once.
PIECE = 256
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A-Z to lower case, other bytes as they are.
LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
#: Also turns every ASCII byte outside 0-9 and a-z into a space, which leaves the words of `words()`.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in (LOWER[i] for i in range(256)))


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters of a UTF-8 text."""
    return text.translate(WORD_BYTES).split()


def written(df: DataFrame) -> DataFrame:
    """The rows of df from a table in the shared folder: lineage ends there, and lost executors cost no recomputation."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes a query's shuffle files when the query ends, and not when its plan happens to be collected. For jobs
    that read what they wrote, and no query's plan twice."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """The written tables of one job; last() writes its result and deletes the others."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def written(self, df: DataFrame) -> DataFrame:
        self.tables.append(written(df))
        return self.tables[-1]

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of the job early; other frames stay as they are."""
        if any(df is t for t in self.tables):
            discard(df)
            self.tables = [t for t in self.tables if t is not df]

    def last(self, df: DataFrame) -> DataFrame:
        out = written(df)
        for table in self.tables:
            discard(table)
        self.tables.clear()
        return out


def map_batches(df: DataFrame, schema: str, func: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """func over pieces of at most PIECE rows of df's Arrow batches, in the executors' Python workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE):
                out = func(whole.slice(at, PIECE))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
