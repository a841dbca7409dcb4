"""Merkle manifest of a dataset by bitmap ranks.

A leaf is the digest of a document's fields. Within each source leaves ascend by doc_id, and three neighbours at a time
become their parent until one node, the source's subroot, is left; subroots, by source, become the root likewise.

No group is sorted to number its leaves. Every source has a bitmap of its ids: words of 64 bits, made in the map tasks and
merged by OR, of which only those with a bit are kept, in containers of 64 words. Above them stands a directory of counts:
of each word within its container, of containers within 2^17 neighbours, of those within 2^17, of those within the source.
Each sum runs over a bounded number of rows, however large a source is or however far its ids lie apart. A leaf's place is
the sum of the counts before its word and the number of lower bits in the word.

Places cut the leaves of a source into blocks of 3^6 slots, keyed by (source, block). A block is reduced by six levels at
once, its top node goes into a slot of the next round's block, and so on: a round for every six levels. On the way back a
block gives each slot the siblings on its way to the top of the block and what the block itself was given. Siblings of
leaves are never shuffled, and a hot source is as many keys as it has blocks.

Null fields are told from empty ones. Null ids stand before all others of their source; documents without a source form the
first source. Rows that share an id within a source are ordered by their leaf, equal rows arbitrarily, which changes nothing;
numbering them takes one window per id. An empty table gives an empty result. Texts are hashed whole. Only the named columns
are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch, map_batches

FAN, DEPTH = 3, 6
SLOTS = FAN**DEPTH
#: Bits of an id's word in a container, and of a place in each step of the directory above.
IN_CONTAINER, STEP = 6, 17
_NULL_WORD = -(1 << 57) - 1
_MASK = (1 << 33) - 1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """A field as its UTF-8 byte count, a colon and the value; null as a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)).cast("binary"), 256)


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def reduced(slots: list[str], levels: int) -> list[list[str]]:
    """The nodes of a block, level by level, from the slots up."""
    out = [slots]
    for _ in range(levels):
        out.append([digest(out[-1][i : i + FAN]) for i in range(0, len(out[-1]), FAN)])
    return out


def siblings(levels: list[list[str]], slot: int) -> list[dict[str, str]]:
    """For each level, what stands before and after a slot's node among those that share its parent."""
    out = []
    for nodes in levels[:-1]:
        first = slot - slot % FAN
        out.append({"before": "".join(nodes[first:slot]), "after": "".join(nodes[slot + 1 : first + FAN])})
        slot //= FAN
    return out


def folded(node: str, path: list[dict[str, str]]) -> str:
    """The root that a node gives with the siblings on its way up."""
    for step in path:
        node = digest([step["before"], node, step["after"]])
    return node


def leaves(docs: DataFrame) -> DataFrame:
    """(g, word, bit, id, leaf, changed) per document; changed: the leaf after tampering, null where that changes nothing.

    g orders sources as the manifest does, null first; word and bit are the id's place in the source's bitmap.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), *[F.col(c).cast(kind).alias(c) for c, kind in zip(FIELDS[1:], ("string", "string", "long", "string"), strict=True)])
    fields = [F.col(c) for c in ("id", *FIELDS[1:4])]
    hit = (F.crc32(F.col("id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    return rows.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("g"), F.coalesce(F.shiftright("id", 6), F.lit(_NULL_WORD)).alias("word"), F.coalesce(F.col("id").bitwiseAND(63).cast("int"), F.lit(0)).alias("bit"),
        "id", leaf(*fields, F.col("text")).alias("leaf"), F.when(hit, leaf(*fields, F.replace("text", F.lit("\n"), F.lit("")))).alias("changed"),
    )


def bitmaps(rows: DataFrame) -> DataFrame:
    """(g, word, bits, n): the words of each source's bitmap, merged by OR, and how many rows each stands for."""
    return rows.groupBy("g", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count("*").alias("n"))


def directory(words: DataFrame) -> DataFrame:
    """(g, container, words: word, bits and rows before it, size: rows of the source) of a table of bitmaps.

    Sums before a row: words in a container (64 at most), containers and their groups (2^17 each), and the top (2^18).
    """
    c = words.groupBy("g", F.shiftright("word", IN_CONTAINER).alias("container")).agg(F.sort_array(F.collect_list(F.struct("word", "bits", "n"))).alias("own"), F.sum("n").alias("n"))
    c = c.withColumn("middle", F.shiftright("container", STEP))
    middles = c.groupBy("g", "middle").agg(F.sum("n").alias("n")).withColumn("top", F.shiftright("middle", STEP))
    tops = middles.groupBy("g", "top").agg(F.sum("n").alias("n"))

    def before(*keys: str, order: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    tops = tops.select("g", "top", before("g", order="top").alias("from_top"), F.sum("n").over(Window.partitionBy("g")).alias("size"))
    middles = middles.withColumn("own_before", before("g", "top", order="middle")).join(tops, ["g", "top"]).select("g", "middle", (F.col("from_top") + F.col("own_before")).alias("from_middle"), "size")
    c = c.withColumn("own_before", before("g", "middle", order="container")).join(middles, ["g", "middle"]).withColumn("start", F.col("from_middle") + F.col("own_before"))
    counted = F.transform("own", lambda w, i: F.struct(w["word"].alias("word"), w["bits"].alias("bits"), (F.col("start") + F.aggregate(F.slice("own", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["n"])).alias("before")))
    return c.select("g", "container", counted.alias("words"), "size")


def placed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows of leaves() with pos (from 0 within the source) and size (rows of the source)."""
    words = scratch.written(bitmaps(rows))
    found = scratch.written(directory(words))
    own = rows.withColumn("container", F.shiftright("word", IN_CONTAINER)).join(found, ["g", "container"])
    own = own.withColumn("at", F.filter("words", lambda w: w["word"] == F.col("word"))[0]).drop("words", "container")
    below = F.bit_count(F.col("at.bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)"))).cast("long")
    odd = words.where(F.col("n") > F.bit_count("bits")).select("g", "word")
    if odd.isEmpty():
        return own.withColumn("pos", F.col("at.before") + below).drop("at")
    single = own.join(odd, ["g", "word"], "left_anti").withColumn("pos", F.col("at.before") + below).drop("at")
    several = own.join(odd, ["g", "word"], "left_semi")
    counts = several.groupBy("g", "word", "bit").agg(F.count("*").alias("n"))
    counts = scratch.written(counts.select("g", "word", "bit", F.coalesce(F.sum("n").over(Window.partitionBy("g", "word").orderBy("bit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lower")))
    nth = F.row_number().over(Window.partitionBy("g", "word", "bit").orderBy("leaf")) - 1
    several = several.join(counts, ["g", "word", "bit"]).withColumn("pos", F.col("at.before") + F.col("lower") + nth).drop("at", "lower")
    return single.unionByName(several)


def levels_of(size: Column) -> Column:
    """How often three nodes become one until one is left of size."""
    return F.size(F.filter(F.array(*[F.lit(FAN**i) for i in range(40)]), lambda p: p < size)).cast("int")


def blocks(nodes: DataFrame, *columns: str) -> DataFrame:
    """(g, block, levels, rest, slots) of nodes (g, pos, rest: levels above, columns): slots in order, rest after the block's levels."""
    made = nodes.groupBy("g", F.expr(f"pos div {SLOTS}").alias("block")).agg(F.max("rest").alias("above"), F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("slots"))
    levels = F.least(F.lit(DEPTH), F.col("above"))
    return made.select("g", "block", levels.alias("levels"), (F.col("above") - levels).alias("rest"), "slots")


def tops(made: DataFrame) -> DataFrame:
    """(g, pos, rest, node): the top node of each block, at its place in the next round."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        nodes = [reduced(s, n)[-1][0] for s, n in zip(b.column("nodes").to_pylist(), b.column("levels").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([b.column("g"), b.column("block"), b.column("rest"), pa.array(nodes, pa.string())], names=["g", "pos", "rest", "node"])

    return map_batches(made.select("g", "block", "levels", "rest", F.col("slots.node").alias("nodes")), "g string, pos long, rest int, node string", run)


_PATH = "array<struct<before:string,after:string>>"


def paths(made: DataFrame, above: DataFrame) -> DataFrame:
    """(g, pos, subroot, path) of every slot of made; above: (g, pos: block, subroot, path) of the blocks themselves."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for g, levels, pos, nodes, subroot, path in zip(*[b.column(c).to_pylist() for c in ("g", "levels", "pos", "nodes", "subroot", "path")], strict=True):
            found = reduced(nodes, levels)
            out += [(g, p, subroot, siblings(found, i) + path) for i, p in enumerate(pos)]
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), kind), strict=True)], names=["g", "pos", "subroot", "path"])

    rows = made.join(above.withColumnRenamed("pos", "block"), ["g", "block"])
    return map_batches(rows.select("g", "levels", F.col("slots.pos").alias("pos"), F.col("slots.node").alias("nodes"), "subroot", "path"), f"g string, pos long, subroot string, path {_PATH}", run)


def rounds(first: DataFrame, scratch: Scratch) -> list[tuple[DataFrame, DataFrame]]:
    """(blocks, their top nodes) of each round, from blocks over the leaves to the last."""
    out = [(first, scratch.written(tops(first)))]
    while not (left := out[-1][1].where("rest > 0")).isEmpty():
        made = scratch.written(blocks(left, "node"))
        out.append((made, scratch.written(tops(made))))
    return out


def numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (g and more) with pos, from 0 in the order of g: a distributed sort, and the counts of its partitions."""
    own = scratch.written(rows.orderBy("g").withColumn("m", F.monotonically_increasing_id())).withColumn("part", F.shiftright("m", 33))
    each = own.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition of the sort
    each = each.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return own.join(F.broadcast(each), "part").withColumn("pos", F.col("before") + F.col("m").bitwiseAND(_MASK)).drop("part", "m", "before")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of docs: a whole manifest and its check.

    Documents whose id has an even CRC-32 are checked as if their line feeds were gone.
    """
    scratch = Scratch()
    own = scratch.written(leaves(docs))
    ready = placed(own, scratch).withColumn("rest", levels_of(F.col("size"))).withColumn("node", F.col("leaf"))
    of_sources = rounds(scratch.written(blocks(ready, "id", "node", "changed")), scratch)
    ended = [made_tops.where("rest = 0") for _, made_tops in of_sources]
    subroots = ended[0]
    for more in ended[1:]:
        subroots = subroots.unionByName(more)
    sources = scratch.written(numbered(subroots.select("g", F.col("node").alias("subroot")), scratch))
    n_sources = sources.count()
    nodes = sources.select(F.lit("").alias("g"), "pos", levels_of(F.lit(n_sources)).alias("rest"), F.col("subroot").alias("node"))
    of_root = rounds(scratch.written(blocks(nodes, "node")), scratch)
    root = next((r.node for r in of_root[-1][1].where("rest = 0").limit(1).collect()), None)

    spark = docs.sparkSession
    down = spark.createDataFrame([("", 0, None, [])], f"g string, pos long, subroot string, path {_PATH}")
    for made, _ in reversed(of_root):
        down = scratch.written(paths(made, down))
    of_source = sources.join(down.select("pos", "path"), "pos").select("g", F.lit(0).cast("long").alias("pos"), "subroot", "path")
    above = None
    for (made, _), done in zip(reversed(of_sources[1:]), reversed(ended[1:]), strict=True):
        here = of_source.join(done.select("g"), "g", "left_semi").select("g", "pos", "subroot", "path")
        above = scratch.written(paths(made, here if above is None else here.unionByName(above)))
    here = of_source.join(ended[0].select("g"), "g", "left_semi").select("g", "pos", "subroot", "path")
    made = of_sources[0][0].join((here if above is None else here.unionByName(above)).withColumnRenamed("pos", "block"), ["g", "block"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                levels, slots, subroot, up = (whole.column(c)[i].as_py() for c in ("levels", "slots", "subroot", "path"))
                found = reduced([s["node"] for s in slots], levels)
                out = []
                for k, s in enumerate(slots):
                    path = siblings(found, k) + up
                    again = folded(s["changed"] or s["node"], path)
                    out.append((s["id"], s["node"], subroot, root, digest([x for step in path for x in (step["before"], step["after"])]), again, again == root))
                kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    rows = made.select("levels", "slots", "subroot", "path").mapInArrow(check, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return scratch.last(rows)
