"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

The smallest neighbour of each node is written before it is joined to the edges: a join of two plain shuffles is one that
Spark splits where a node has very many edges. An aggregate below the join would keep them in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch, discard, written


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = scratch.written(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of distinct edges hold the same ones."""
    return a.count() == b.count() and a.join(b, ["u", "v"], "left_anti").isEmpty()


def components(edges: DataFrame, own: Scratch | None = None) -> DataFrame:
    """(u, v) edges of longs to (node, root): each node that has an edge, with the smallest node reachable from it.

    The edges stay in Spark; only counts reach the driver. Rounds grow with the logarithm of the longest chain and end
    when one changes no edge. Self-loops and repeated edges are allowed; no edges give no rows. Each round's tables are
    written to the shared folder, and those before them are deleted; own: the job that the last one belongs to.
    """
    now = written(edges.select("u", "v").where("u <> v").distinct())
    while not now.isEmpty():
        scratch = Scratch()
        new = scratch.last(_small_star(scratch.written(_large_star(now, scratch)), scratch))
        done = _same(now, new)
        discard(now)
        now = new
        if done:
            break
    if own is not None:
        own.tables.append(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
