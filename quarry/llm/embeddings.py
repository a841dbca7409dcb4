"""Embedding near-dedup by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; its hash is the axis, with sign, of
the largest coordinate. `hashes` such hashes make a bucket of one table, and besides its own bucket a vector enters those
of its `probes` likeliest next choices. Equal vectors are one item. Items that share a bucket in some table are
compared whole, in bounded blocks, by cosine in double precision, and only pairs at or above `least` link, so no false
link is possible.

A vector would travel once for each bucket that it shares. Near copies share most of their buckets, so buckets are joined
by their leader, the smallest item in each: all buckets of one leader are one group, and a vector travels once for each
group. A pair that meets in several groups is counted in the first of them only.

Linked pairs leave a block as counts per item and as stars, never as pairs, so a group of near copies costs its size.
Vectors that are null, zero, or hold null or non-finite components, and rows without an id, link with nothing and stand
for themselves. Vectors of different lengths never link. Repeated rows count as further vectors. Extra columns, of any
name, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.blocks import chunks, forest, map_blocks, places, starts
from quarry.llm.components import components
from quarry.llm.shared import Scratch, batch


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


@lru_cache(maxsize=64)
def _signs(d: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, d]).choice([-1.0, 1.0], size=(count, 3, d))


def codes(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """Of n vectors, n x (tables * (probes + 1)) bucket codes."""
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    full = np.zeros((n, d))
    full[:, :dim] = x
    out = np.empty((n, tables, probes + 1), np.int64)
    signs = _signs(d, tables * hashes, seed)
    every = np.arange(n)
    for t in range(tables):
        first, second, gap = [], [], []
        for k in range(hashes):
            y = full
            for s in signs[t * hashes + k]:
                y = hadamard(y * s)
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            swap = size[every, top[:, 0]] < size[every, top[:, 1]]
            top[swap] = top[swap][:, ::-1]
            axis = 2 * top + (y[every[:, None], top] < 0)
            first.append(axis[:, 0])
            second.append(axis[:, 1])
            gap.append(size[every, top[:, 0]] - size[every, top[:, 1]])
        choice, gap = np.stack(first, 1), np.stack(gap, 1)
        order = np.argsort(gap, axis=1, kind="stable")
        for p in range(probes + 1):  # the likeliest other buckets differ in the hash with the smallest gap
            axes = choice.copy()
            if p:
                at = order[:, (p - 1) % hashes]
                axes[every, at] = np.stack(second, 1)[every, at]
            code = np.full(n, dim * tables + t, np.int64)
            for k in range(hashes):
                code = code * (2 * d) + axes[:, k]
            out[:, t, p] = code
    return out.reshape(n, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _compare(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray, bucket: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of unit rows with cosine of at least `least` that share no group before this one."""
    i, j = np.nonzero(a @ b.T >= least)
    keep = np.ones(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        x, y = ca[i[at : at + (1 << 16)]], cb[j[at : at + (1 << 16)]]
        earlier = np.zeros(len(x), bool)
        for k in range(x.shape[1]):
            earlier |= ((x[:, k : k + 1] == y) & (y >= 0)).any(axis=1) & (x[:, k] < bucket)
        keep[at : at + (1 << 16)] = ~earlier
    return i[keep], j[keep]


def block_links(table: pa.Table, least: float, side: int = 512) -> pa.Table:
    """(rid, n, root) per item of a run of blocks that has links there: copies of the items linked to it, and its star."""
    rid, copies, at_side, buckets = (table.column(x).to_numpy() for x in ("rid", "copies", "side", "bucket"))
    vectors, lists = table.column("vector").combine_chunks(), table.column("leaders").to_pylist()
    sizes = vectors.value_lengths().to_numpy()
    ends = np.cumsum(sizes)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    wide = max(map(len, lists))
    known = np.array([c + [-1] * (wide - len(c)) for c in lists], np.int64)
    edges = starts(table)
    out_a, out_b = [], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        cross = (at_side[a:b] == 1).any() or table.column("ci")[a] != table.column("cj")[a]
        for size in np.unique(sizes[a:b]).tolist():
            mine = np.arange(a, b)[sizes[a:b] == size]
            unit = _unit(flat[(ends[mine] - size)[:, None] + np.arange(size)])
            left, right = np.flatnonzero(at_side[mine] == 0), np.flatnonzero(at_side[mine] == 1)
            other = right if cross else left
            for i in range(0, len(left), side):
                for j in range(0 if cross else i, len(other), side):
                    p, q = left[i : i + side], other[j : j + side]
                    u, v = _compare(unit[p], unit[q], known[mine[p]], known[mine[q]], int(buckets[a]), least)
                    u, v = mine[p[u]], mine[q[v]]
                    if not cross:
                        u, v = u[u < v], v[u < v]
                    out_a.append(u)
                    out_b.append(v)
    u, v = (np.concatenate(s) if s else np.zeros(0, int) for s in (out_a, out_b))
    n = np.bincount(u, copies[v], table.num_rows) + np.bincount(v, copies[u], table.num_rows)
    root = forest(table.num_rows, u, v)
    at = np.flatnonzero(n > 0)
    return pa.table({"rid": rid[at], "n": n[at].astype(np.int64), "root": rid[root[at]]})


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, tables: int = 8, hashes: int = 3, probes: int = 2, block: int = 2048, seed: int = 11) -> DataFrame:
    """(id_col, n_links, component_id, kept) per row of vectors.

    n_links: other vectors linked directly; component_id: the smallest id reachable over links; kept: whether it is
    the row's own. Equal vectors are told by 128 bits of hashes. Vectors travel only for items that share a bucket with
    another; all tables stay in Spark.
    """
    scratch = Scratch()
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).withColumn("sound", F.coalesce(F.col("id").isNotNull() & sound, F.lit(False)))
    valid = rows.where("sound").withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.xxhash64(F.lit(1), "vector"))
    items = scratch.written(valid.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("vector").alias("vector")).withColumn("rid", F.monotonically_increasing_id()))

    def hashed(batches):
        for b in batches:
            found = b.column(1).to_pylist()
            for size in sorted({len(v) for v in found}):
                own = np.array([i for i, v in enumerate(found) if len(v) == size])
                for at in range(0, len(own), 1024):
                    part = own[at : at + 1024]
                    c = codes(_unit(np.array([found[i] for i in part], np.float64)), tables, hashes, probes, seed)
                    ids = b.column(0).to_numpy()[part]
                    one = np.unique(np.stack([np.repeat(ids, c.shape[1]), c.ravel()]), axis=1)
                    yield batch(rid=pa.array(one[0]), code=pa.array(one[1]))

    keys = scratch.written(items.select("rid", "vector").mapInArrow(hashed, "rid long, code long"))
    leaders = scratch.written(keys.groupBy("code").agg(F.count("*").alias("n"), F.min("rid").alias("leader")).where("n > 1").select("code", "leader"))
    grouped = scratch.written(keys.join(leaders, "code").select("rid", "leader").distinct())
    sizes = scratch.written(grouped.groupBy("leader").agg(chunks(F.count("*"), block).alias("n")))
    lists = grouped.join(sizes, "leader").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("leader", "n"))).alias("groups"))  # tables * (probes + 1) at most
    at = F.flatten(F.transform("groups", lambda g: F.transform(places(F.col("rid"), g["n"]), lambda p: F.struct(g["leader"].alias("bucket"), p["ci"].alias("ci"), p["cj"].alias("cj"), p["side"].alias("side")))))
    dealt_out = items.join(lists, "rid").select("rid", "copies", "vector", F.col("groups.leader").alias("leaders"), F.explode(at).alias("at")).select("rid", "copies", "vector", "leaders", "at.*")
    links = scratch.written(map_blocks(dealt_out, "rid long, n long, root long", lambda t: block_links(t, least)))
    roots = components(links.select(F.col("rid").alias("u"), F.col("root").alias("v")), scratch)
    counted = items.join(links.groupBy("rid").agg(F.sum("n").alias("n")), "rid", "left").join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left")
    counted = scratch.written(counted.select("k1", "k2", "first", F.coalesce("root", "rid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least_id = scratch.written(counted.groupBy("root").agg(F.min("first").alias("component_id")))
    done = scratch.written(counted.join(least_id, "root").select("k1", "k2", "n_links", "component_id"))
    out = valid.select("id", "k1", "k2").join(done, ["k1", "k2"]).select("id", "n_links", "component_id")
    rest = rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return scratch.last(out.union(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")))
