"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint has bit i set where over half of its shingles' hashes have it. Fingerprints that share a bucket
are compared whole, in bounded blocks. Inside a block they are stored as 64 vertical bit planes. One vector operation on
a plane compares the same bit of 64 pairs in each machine word; carry-save counter planes and one overflow plane count
the differing bits, and words whose 64 pairs all lie past the radius are abandoned after every few planes.

By radius (up to 3 bits): two fingerprints are linked at a distance of at most `radius` bits. The 64 bits are cut into
radius + 2 ranges; two linked fingerprints agree in at least 2 of them, so each distinct fingerprint goes to the buckets
of its pairs of ranges, and no link is lost.

By similarity: two texts are linked where the sets of their shingles have a Jaccard similarity of at least `similarity`.
At 0.8 two fingerprints lie about 10 of 64 bits apart, far too many for ranges of agreeing bits, so the buckets come from
the least shingle hashes (jaccard.py). Blocks are compared as above, at a radius of `SCREEN` bits, which a pair of 0.8
passes but for about 1 in 100,000, and an unrelated one in 7 of 100 cases; pairs within it are compared by their
whole sets, so every link is exact, but for equal 64-bit hashes of different shingles. Pairs that earlier links of the
block join already are not compared. Texts without words equal each other and nothing else.

Equal fingerprints, or sets, are one item in all of this, so exact copies cost one row. Linked items leave a block as
stars, never as all pairs; components of the stars are found by rounds of joins (components.py). What is joined by a key
that may be hot is written first, so that Spark can split the join.

Null texts count as empty; by radius, a text without words has fingerprint 0 and links like any other. Texts are read
whole. A null doc_id takes part with its text but is nobody's component_id (null, if a group has no other). Repeated rows
give repeated result rows. An empty table gives an empty result. Only the two named columns are read, so others may have
any name.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import jaccard
from quarry.llm.blocks import dealt, forest, map_blocks, starts
from quarry.llm.components import components
from quarry.llm.shared import Scratch, batch, map_batches, utf8

#: Shingles whose bits are counted at once.
_AT_ONCE = 1 << 15
#: Bits within which pairs are compared by their shingles.
SCREEN = 26


def majority(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes, repeats included."""
    if not len(h):
        return 0
    h = h.astype("<u8")
    ones = sum(np.unpackbits(h[i : i + _AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(h), _AT_ONCE))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text: words between ASCII white space, shingles of `width` words, XXH64."""
    return majority(jaccard.shingles(text, width, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id_col, fp) per row; fp has the 64 bits as a signed long."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, width) for t in utf8(b.column(1))], dtype=np.uint64).view(np.int64)
        return batch(id=b.column(0), fp=pa.array(fp))

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), f"id {kind}, fp long", run).withColumnRenamed("id", id_col)


def planes(fp: np.ndarray) -> np.ndarray:
    """64 bit planes of n fingerprints: row k holds bit k of item j at bit j % 64 of word j // 64."""
    n = -(-len(fp) // 64) * 64
    full = np.zeros(n, np.uint64)
    full[: len(fp)] = fp
    bits = np.unpackbits(full.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _past(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """The lanes whose bit-sliced count is over radius."""
    over, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ~np.uint64(0))
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            over |= equal & counters[k]
            equal &= ~counters[k]
    return over


def _near(x: np.ndarray, y: np.ndarray, alive: np.ndarray, radius: int, step: int = 8) -> np.ndarray:
    """Of the word lanes set in alive, those whose columns of the plane sets x and y differ in at most radius bits.

    x, y: 64 planes of words. Carry-save counters: plane k of the counters is bit k of the count, over is set past what
    they can hold. Words without a live lane are dropped after every `step` planes.
    """
    out = np.zeros_like(alive)
    at = np.flatnonzero(alive)
    counters = [np.zeros(len(at), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(len(at), np.uint64)
    for k in range(0, 64, step):
        if not len(at):
            return out
        for d in x[k : k + step, at] ^ y[k : k + step, at]:
            carry = d
            for c in counters:
                c_next = c & carry
                c ^= carry
                carry = c_next
            over |= carry
        if radius > k + step:  # none can be past it yet
            continue
        far = over | _past(counters, radius)
        live = np.flatnonzero(~far & alive[at])
        if len(live) < len(at):
            at, over, counters = at[live], over[live], [c[live] for c in counters]
    out[at] = ~(over | _past(counters, radius)) & alive[at]
    return out


def _lanes(words_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words_.astype("<u8").view(np.uint8), bitorder="little"))


def _links_small(fp: np.ndarray, block: np.ndarray, longest: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside blocks of up to `longest` items: all items against those s places on, for each s, in one pass each."""
    p, a, b = planes(fp), [], []
    for s in range(1, longest):
        same = np.zeros(p.shape[1] * 64, bool)
        same[: len(fp) - s] = block[s:] == block[:-s]
        if not same.any():
            break
        alive = np.packbits(same, bitorder="little").view("<u8")
        i = _lanes(_near(p, planes(np.concatenate([fp[s:], np.zeros(s, np.uint64)])), alive, radius))
        a.append(i)
        b.append(i + s)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _links_large(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside one block: each item's bits, spread over all lanes, against the planes of the block."""
    p, a, b = planes(fp), [], []
    every = np.full(p.shape[1], ~np.uint64(0))
    every[-1] = np.uint64((1 << (len(fp) - 1) % 64 + 1) - 1)
    spread = np.where(np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), ~np.uint64(0), np.uint64(0))
    for i, bits in enumerate(spread):
        found = _lanes(_near(p, np.broadcast_to(bits[:, None], p.shape), every, radius))
        found = found[found > i]
        a.append(np.full(len(found), i))
        b.append(found)
    return np.concatenate(a), np.concatenate(b)


def block_links(fp: np.ndarray, edges: np.ndarray, radius: int, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of fingerprints of one block at a distance of at most radius; edges: where blocks begin and end."""
    sizes = np.diff(edges)
    block = np.repeat(np.arange(len(sizes)), sizes)
    little = np.flatnonzero(np.repeat(sizes <= small, sizes))
    a, b = _links_small(fp[little], block[little], small, radius) if len(little) else (np.zeros(0, int),) * 2
    a, b = [little[a]], [little[b]]
    for i in np.flatnonzero(sizes > small):
        x, y = _links_large(fp[edges[i] : edges[i + 1]], radius)
        a.append(x + edges[i])
        b.append(y + edges[i])
    return np.concatenate(a), np.concatenate(b)


def _stars(names: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    root = forest(len(names), a, b)
    moved = np.flatnonzero(root != np.arange(len(names)))
    return pa.table({"u": names[moved], "v": names[root[moved]]})


def block_stars(table: pa.Table, radius: int = 3) -> pa.Table:
    """(u, v) per fingerprint of a run of blocks that is linked, directly or not, to an earlier one v of its block."""
    fp = table.column("fp").to_numpy()
    return _stars(fp, *block_links(fp.view(np.uint64), starts(table), radius))


def similar_stars(table: pa.Table, similarity: float, radius: int = SCREEN) -> pa.Table:
    """(u, v) per node of a run of blocks that is linked, directly or not, to another one v of its block."""
    names, binary = table.column("node").to_numpy(), table.column("shingles")
    a, b = block_links(table.column("fp").to_numpy().view(np.uint64), starts(table), radius)
    order = np.lexsort((b, a))
    group, x, y, sets = list(range(len(names))), [], [], {}

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    def shingles(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.frombuffer(binary[i].as_py(), "<u8")
        return sets[i]

    last = -1
    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        if i != last:
            sets.pop(last, None)
            last = i
        p, q = top(i), top(j)
        if p != q and names[i] != names[j] and jaccard.alike(shingles(i), shingles(j), similarity):
            group[max(p, q)] = min(p, q)
            x.append(i)
            y.append(j)
    return _stars(names, np.array(x, int), np.array(y, int))


def _ranges(radius: int) -> list[tuple[int, int]]:
    """64 bits cut into radius + 2 ranges (shift, width), as even as can be."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def linked(distinct: DataFrame, scratch: Scratch, radius: int = 3, block: int = 4096) -> DataFrame:
    """(node, root) for each of the distinct fingerprints (column fp) that links to another."""
    pieces = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in _ranges(radius)]
    keys = F.array(*[F.xxhash64(F.lit(t), pieces[i], pieces[j]) for t, (i, j) in enumerate(combinations(range(len(pieces)), 2))])
    rows = dealt(distinct.select("fp", F.explode(keys).alias("key")), F.col("key"), F.col("fp"), scratch, block)
    return components(map_blocks(rows.select("fp", "bucket", "ci", "cj"), "u long, v long", lambda t: block_stars(t, radius)), scratch)


def _named(own: DataFrame, distinct: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """own (id, node, ...) with component_id; distinct: node and its smallest id, least; found: node and root of linked ones."""
    rooted = scratch.written(distinct.select("node", "least").join(found.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    least = scratch.written(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return own.join(scratch.written(rooted.join(least, "root").select("node", "component_id")), "node")


def _by_similarity(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, block: int, scratch: Scratch) -> DataFrame:
    """Names, fingerprints and buckets are computed once and written. Texts are read again, and shuffled, only for nodes in shared buckets."""
    texts, keys = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), [f"b{t}" for t in range(jaccard.BANDS)]
    texts = texts.withColumn("text_hash", F.xxhash64("text"))

    def signed(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [jaccard.shingles(t, width) for t in utf8(b.column(2))]
        sets = [np.unique(h) for h in hashes]
        made = np.array([jaccard.bands(s) if len(s) else np.zeros(jaccard.BANDS, np.int64) for s in sets]).reshape(-1, jaccard.BANDS)
        return batch(id=b.column(0), text_hash=b.column(1), node=pa.array([jaccard.node(s) for s in sets], pa.int64()), n=pa.array([len(s) for s in sets], pa.int64()), **{k: pa.array(np.ascontiguousarray(made[:, t])) for t, k in enumerate(keys)})

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [jaccard.shingles(t, width) for t in utf8(b.column(0))]
        sets = [np.unique(h) for h in hashes]
        fp = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
        return batch(node=pa.array([jaccard.node(s) for s in sets], pa.int64()), fp=pa.array(fp), shingles=pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()))

    kind = docs.schema[id_col].dataType.simpleString()
    own = scratch.written(map_batches(texts.select("id", "text_hash", "text"), f"id {kind}, text_hash long, node long, n long, {', '.join(f'{k} long' for k in keys)}", signed))
    distinct = scratch.written(own.groupBy("node").agg(F.min("id").alias("least"), *[F.min(c).alias(c) for c in ("text_hash", "n", *keys)]))
    items = distinct.where("n > 0").select("node", F.explode(F.array(*keys)).alias("key"))
    rows = scratch.written(dealt(items, F.col("key"), F.col("node"), scratch, block).select("node", "bucket", "ci", "cj"))
    shared = scratch.written(distinct.join(rows.select("node").distinct(), "node", "left_semi").select("text_hash"))
    again = texts.join(shared, "text_hash", "left_semi").dropDuplicates(["text_hash"]).select("text")
    sets = scratch.written(map_batches(again, "node long, fp long, shingles binary", whole))
    found = components(map_blocks(rows.join(sets, "node").select("node", "fp", "shingles", "bucket", "ci", "cj"), "u long, v long", lambda t: similar_stars(t, similarity)), scratch)
    return _named(own.select("id", "node"), distinct, found, scratch).select(F.col("id").alias(id_col), "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3, similarity: float | None = None, block: int | None = None) -> DataFrame:
    """(id_col, fingerprint as 16 hex digits, component_id: the smallest id reachable over links) per row of docs.

    By radius (0 to 3 bits), or where similarity is given by Jaccard similarity of shingles, without the fingerprint.
    Fingerprints are computed once and written; everything after works on 8-byte rows. The result is a written table.
    """
    scratch = Scratch()
    if similarity is not None:
        return scratch.last(_by_similarity(docs, id_col, text_col, width, similarity, block or 256, scratch))
    own = scratch.written(fingerprints(docs, id_col, text_col, width).select(F.col(id_col).alias("id"), F.col("fp").alias("node")))
    distinct = scratch.written(own.groupBy("node").agg(F.min("id").alias("least")))
    found = linked(distinct.select(F.col("node").alias("fp")), scratch, radius, block or 4096)
    out = _named(own, distinct, found, scratch)
    return scratch.last(out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id"))
