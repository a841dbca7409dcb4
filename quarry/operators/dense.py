"""Dense top-k between tables of any size: blocks of queries against blocks of vectors, and blocks that can't matter skipped.

Vectors are dealt to the nearest of a few pivots, and each pivot's cell has a radius: its largest angle to one of its
vectors. By the triangle inequality no vector of a cell is nearer to a query than the query's angle to the pivot less the
radius. A query is first compared with its nearest cells, as many as hold k vectors; after that only cells that can hold
a vector as near as the k-th of those are left. Exact, whatever the pivots are; how much is skipped depends on the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.tables import kept

#: Pivots (the only rows that reach the driver), vectors and queries of a block, and what rounding may add to an angle.
PIVOTS, BLOCK, SLACK = 64, 4096, 1e-6
#: Cosines are rounded to so many digits before they are compared.
DIGITS = 6


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def _celled(rows: DataFrame, pivots: dict[int, np.ndarray], nearest: bool) -> DataFrame:
    """rows (id, vector) with dim, cell and angle: to the nearest pivot of the same length, or a row for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy()
            for dim in np.unique(sizes).tolist():
                own = b.filter(pa.array(sizes == dim)) if (sizes != dim).any() else b
                angle = _angles(_matrix(own.column(1)), pivots[dim])
                cell = angle.argmin(axis=1) if nearest else np.tile(np.arange(angle.shape[1]), len(angle))
                row = np.arange(len(angle)) if nearest else np.repeat(np.arange(len(angle)), angle.shape[1])
                columns = own.take(pa.array(row)).columns if not nearest else own.columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(row), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(angle[row, cell])], names=["id", "vector", "dim", "cell", "angle"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, f"id {kind}, vector array<double>, dim int, cell int, angle double")


def _pivots(vectors: DataFrame, most: int) -> dict[int, np.ndarray]:
    """Per length, the vectors of smallest hash: at most `most` rows for each length there is."""
    order = Window.partitionBy(F.size("vector")).orderBy(F.xxhash64("id"), "id")
    rows = vectors.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("vector").collect()
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(len(r.vector), []).append(r.vector)
    return {d: np.array(v, float) for d, v in found.items()}


def _best(asked: np.ndarray, ids: list, vectors: pa.Array, chunks: pa.Array, k: int, kind: pa.DataType, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The k best chunks of each query, by the rounded cosine and then the smaller id, as they are compared in the end."""
    order = pc.sort_indices(chunks)
    chunks, held = chunks.take(order), _matrix(vectors.take(order)).T
    for at in range(0, len(ids), rows):
        scores = np.floor(asked[at : at + rows] @ held * 10.0**DIGITS + 0.5) / 10.0**DIGITS
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        row = np.repeat(np.arange(len(scores)), best.shape[1])
        found = scores[row, best.ravel()]
        keep = found > 0
        yield pa.RecordBatch.from_arrays([pa.array([ids[at + i] for i in row[keep]], kind), chunks.take(pa.array(best.ravel()[keep])), pa.array(found[keep])], names=["query_id", "chunk_id", "dense"])


def _products(pairs: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, dense) of the k best of each query in each batch of the cells that it is paired with.

    pairs: id, vector, dim, cell; vectors: id, vector, dim, cell, part, parts. A task holds a block of queries and reads
    the vectors of one part of a cell, so it is bounded whatever the cell and the number of queries.
    """
    blocks = pairs.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cells = kept(vectors.select("dim", "cell", "parts").distinct().join(blocks, ["dim", "cell"]))
    q_kind, v_kind = (x.schema["id"].dataType.simpleString() for x in (pairs, vectors))
    asked = pairs.join(cells, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    here = vectors.join(cells.drop("parts"), ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = ["dim", "cell", "part", "block"]
    asked = asked.select(*place, F.lit(0).alias("kind"), F.col("id").alias("query_id"), F.lit(None).cast(v_kind).alias("chunk_id"), "vector")
    here = here.select(*place, F.lit(1).alias("kind"), F.lit(None).cast(q_kind).alias("query_id"), F.col("id").alias("chunk_id"), "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held = None, [], []
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(5)])
            cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if lo == hi:
                    continue
                if at is None or (keys[:4, lo] != at).any():
                    at, ids, held = keys[:4, lo], [], []
                part = b.slice(lo, hi - lo)
                if not keys[4, lo]:
                    ids += part.column(5).to_pylist()
                    held.append(_matrix(part.column(7)))
                elif held:
                    if len(held) > 1:
                        held = [np.concatenate(held)]
                    yield from _best(held[0], ids, part.column(7), part.column(6), k, b.column(5).type)

    return asked.unionByName(here).repartition(*place).sortWithinPartitions(*place, "kind").mapInArrow(run, f"query_id {q_kind}, chunk_id {v_kind}, dense double")


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, chunk_id, dense, rank): the k chunks of largest cosine above 0 per query; ties go to the smaller chunk_id.

    queries: query_id, vector; vectors: chunk_id, vector, of unit length or empty. Cosines are rounded to six digits
    before they are compared. The plan is the same for any number of queries.
    """
    own = vectors.where(F.size("vector") > 0).select(F.col("chunk_id").alias("id"), "vector")
    known = _pivots(own, pivots)
    dims = [*known] or [0]
    own = kept(_celled(own, known, True))
    sizes = kept(own.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")))  # pivots rows per length
    own = own.join(F.broadcast(sizes.select("dim", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    asked = queries.where(F.size("vector").isin(*dims)).select(F.col("query_id").alias("id"), "vector")
    pairs = kept(_celled(asked, known, False).join(F.broadcast(sizes), ["dim", "cell"]).withColumn("least", F.greatest(F.col("angle") - F.col("radius"), F.lit(0.0))))
    near = Window.partitionBy("id").orderBy("angle", "cell")
    first = pairs.withColumn("before", F.coalesce(F.sum("n").over(near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("first", F.col("before") < k)
    first = kept(first.select("id", "vector", "dim", "cell", "least", "first"))
    best = Window.partitionBy("query_id").orderBy(F.col("dense").desc(), "chunk_id")
    early = kept(_products(first.where("first"), own, k))
    far = early.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select(F.col("query_id").alias("id"), F.acos(F.least(F.lit(1.0), F.col("dense") - SLACK)).alias("far"))
    late = first.where("not first").join(far, "id", "left").where(F.col("far").isNull() | (F.col("least") <= F.col("far") + SLACK)).drop("far")
    rows = early.unionByName(_products(late, own, k)).withColumn("dense", F.round("dense", DIGITS)).where("dense > 0")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
