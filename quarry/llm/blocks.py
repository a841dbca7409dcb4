"""Buckets of items dealt to tasks as bounded blocks.

Items that share a bucket must be compared, but a bucket may hold any share of the items. A bucket of up to `block`
items is one block. A larger one is cut into chunks by a hash of the item, and each pair of chunks is a block of its
own, on its own key: no task ever holds more than two chunks, and a hot bucket spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch


def chunks(size: Column, block: int) -> Column:
    """The number of chunks of a bucket of `size` items."""
    return F.ceil(size / F.lit(block)).cast("int")


def places(item: Column, n: Column) -> Column:
    """Array of (ci, cj, side): the blocks of a bucket of n chunks that an item takes part in.

    side is 0 for an item of chunk ci and 1 for one of chunk cj; in a block with ci = cj every item has side 0.
    """
    mine = F.pmod(F.xxhash64(item, F.lit("chunk")), n.cast("long")).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least(mine, j).alias("ci"), F.greatest(mine, j).alias("cj"), (mine > j).cast("int").alias("side")))


def dealt(items: DataFrame, bucket: Column, item: Column, scratch: Scratch, block: int = 4096) -> DataFrame:
    """items with (bucket, ci, cj, side): one row per block that the item takes part in, none if it is alone in its bucket.

    The sizes of buckets are written first, so that the join to them is one that Spark splits at a hot bucket.
    """
    rows = items.withColumn("bucket", bucket)
    sizes = scratch.written(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket", chunks(F.col("size"), block).alias("n_chunks")))
    at = F.explode(places(item, F.col("n_chunks")))
    return rows.join(sizes, "bucket").withColumn("at", at).select(*items.columns, "bucket", F.col("at.ci").alias("ci"), F.col("at.cj").alias("cj"), F.col("at.side").alias("side"))


def map_blocks(rows: DataFrame, schema: str, func: Callable[[pa.Table], pa.Table | None]) -> DataFrame:
    """func over runs of whole blocks of dealt() rows; a table that func sees is sorted by (bucket, ci, cj).

    Small blocks come many at a time, so that func can work on all of them with a few vector operations.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            same = np.ones(b.num_rows, bool)
            for name in ("bucket", "ci", "cj"):
                column = b.column(name).to_numpy(zero_copy_only=False)
                same &= column == column[-1]
            cut = b.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if held and cut == 0 and any(held[-1].column(x)[-1] != b.column(x)[0] for x in ("bucket", "ci", "cj")):
                yield from done(held)
                held = []
            if cut:
                yield from done([*held, b.slice(0, cut)])
                held = []
            held.append(b.slice(cut))
        yield from done(held)

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts and (out := func(pa.Table.from_batches(parts))) is not None:
            yield from (b for b in out.to_batches() if b.num_rows)

    return rows.repartition("bucket", "ci", "cj").sortWithinPartitions("bucket", "ci", "cj").mapInArrow(run, schema)


def starts(table: pa.Table) -> np.ndarray:
    """The first row of each block of a sorted table, and the number of rows."""
    keys = np.stack([table.column(x).to_numpy().astype(np.int64) for x in ("bucket", "ci", "cj")])
    change = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
    return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For the links a[i]-b[i] between n items, the smallest item that each reaches: a star stands for all its links."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
        while (deeper := root[root]).tobytes() != root.tobytes():
            root = deeper
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
        if not len(a) and (before == root).all():
            break
    return root
