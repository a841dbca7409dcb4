"""Retrieval for whole tables of queries: pruning, scores, top-k, balance and fusion.

Keys are (query_id, variant_no) throughout; every order ends in chunk_id, and scores are rounded to `DIGITS` before
they are compared, so that equal chunks tie whatever order their sums ran in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.index import Index, hashed_vectors, keyed_lists, token_key
from quarry.operators.rules import Rules
from quarry.sources.tables import kept

DIGITS = 6
QV = ("query_id", "variant_no")


@dataclass(frozen=True)
class Limits:
    """How many hits a search returns for a query, and how long their excerpts are."""

    hits: int
    chars: int


#: For candidates that something else chooses from, and for answers.
CANDIDATES, ANSWERS, STRICT = Limits(15, 700), Limits(3, 520), Limits(5, 900)


def answer_limits(strict: bool = False, own: Limits = ANSWERS, least: Limits = STRICT) -> Limits:
    """own; when answers must be strict, at least as much as least."""
    return Limits(max(own.hits, least.hits), max(own.chars, least.chars)) if strict else own


def query_tokens(queries: DataFrame, tokens: Column) -> DataFrame:
    """(query_id, variant_no, token) of the distinct tokens of each query."""
    return queries.select(*QV, F.explode(F.array_distinct(tokens)).alias("token"))


def lists(tokens: DataFrame, posted: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """tokens (token, n_salts and others) with the chunk_id, and columns, of their posting lists.

    A list that the index has cut into n_salts pieces is joined piece by piece, so a frequent token is many keys.
    """
    if "salt" not in posted.columns:
        return tokens.join(posted.select("token", "chunk_id", *columns), "token")
    pieces = tokens.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)))
    return pieces.join(posted.select("token", "salt", "chunk_id", *columns), ["token", "salt"]).drop("salt", "n_salts")


def candidates(tokens: DataFrame, posted: DataFrame, stats: DataFrame, df: DataFrame, target: int = 1200, most_tokens: int = 72, common: float = 0.85, chunks: DataFrame | None = None) -> DataFrame:
    """(query_id, variant_no, chunk_id) of the chunks worth scoring.

    A query's tokens are taken rarest first, longer ones and then the alphabet deciding ties; tokens in `common` of all
    chunks don't count. Posting lists are added until there are `target` chunks or `most_tokens` tokens. Exactly that,
    without a loop: a chunk enters at its first token's rank, and a rank is used while the ranks before it have brought
    fewer than target chunks. The chunks before a rank are at least as many as the list before it is long, so at most one
    list of target or more chunks is read for a query, and no other frequent token is joined at all.

    chunks (chunk_id): what a query without a usable token gets, namely all of them. That is a cross join of such queries
    and all chunks, which are all its result; without chunks they get none.
    """
    target = max(50, target)
    usable = tokens.join(df, "token").join(F.broadcast(stats.select("n"))).where(F.col("df") < F.greatest(F.col("n") * common, F.lit(1.0))).drop("n")
    order = Window.partitionBy(*QV).orderBy("df", F.length("token").desc(), "token")
    ranked = usable.withColumn("r", F.row_number().over(order)).withColumn("list_before", F.lag("df", 1, 0).over(order))
    ranked = ranked.where((F.col("r") <= most_tokens) & (F.col("list_before") < target)).drop("df", "list_before")
    first = lists(ranked, posted).groupBy(*QV, "chunk_id").agg(F.min("r").alias("r"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*QV).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = first.groupBy(*QV, "r").agg(F.count("*").alias("n")).withColumn("before", before).where((F.col("r") == 1) | (F.col("before") < target)).select(*QV, "r")
    out = first.join(used, [*QV, "r"], "left_semi").select(*QV, "chunk_id")
    if chunks is not None:
        without = tokens.select(*QV).distinct().join(ranked.select(*QV).distinct(), list(QV), "left_anti")
        out = out.union(without.join(chunks.select("chunk_id")))
    return out


def bm25(tokens: DataFrame, index: Index) -> DataFrame:
    """(query_id, variant_no, chunk_id, bm25) of every chunk with a token of the query; sums are partial before the shuffle."""
    rows = lists(tokens.join(index.tokens.select("token", "n_salts"), "token"), index.postings, ["part"])
    return rows.groupBy(*QV, "chunk_id").agg(F.sum("part").alias("bm25"))


def query_side(tokens: DataFrame) -> DataFrame:
    """(query_id, variant_no, keys, weights) of the tokens of each query, to go with an index's forward table."""
    return tokens.groupBy(*QV).agg(F.sort_array(F.collect_list(token_key(F.col("token")))).alias("keys")).withColumn("weights", F.transform("keys", lambda k: F.lit(1.0)))


def vector_side(tokens: DataFrame, dim: int = 768) -> DataFrame:
    """(query_id, variant_no, keys, weights) of the hashed vector of each query, to go with an index's vectors."""
    own = hashed_vectors(tokens.withColumn("tf", F.lit(1)), dim, QV)
    return keyed_lists(own.select(*QV, F.col("bucket").alias("key"), F.col("w").alias("weight")), QV)


def pair_scores(among: DataFrame, queries: DataFrame, chunks: DataFrame, name: str, most: int = 4096) -> DataFrame:
    """(query_id, variant_no, chunk_id, name): for each pair the sum over common keys of the product of both weights.

    queries: query_id, variant_no, keys, weights; chunks: chunk_id, keys (sorted), weights. The work follows the pairs,
    whatever tokens they share: a chunk's keys come once to a block of about `most` queries and are looked up in one go.
    The queries of a block are dealt to its tasks ahead of the chunks, all within the plan: nothing is collected, and a
    task holds one block of queries and a batch of chunks. Pairs without a common key are left out.
    """
    ids = [(c, among.schema[c].dataType.simpleString()) for c in (*QV, "chunk_id")]
    asked_type = f"array<struct<{', '.join(f'{c}:{t}' for c, t in ids[:2])}>>"
    tasks = int(among.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = 4 * tasks  # dealt by hash, so that few tasks get none and few get many
    blocks = queries.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / most)).cast("int").alias("n_blocks"))
    block, spread = F.pmod(F.xxhash64(*QV), F.col("n_blocks")).cast("int"), F.greatest(F.lit(1), F.expr(f"{slots} div n_blocks").cast("int"))
    sides = queries.join(F.broadcast(blocks)).withColumn("spread", spread).select(*QV, (block * F.col("spread")).alias("first"), "spread", "keys", "weights")
    sides = sides.select(F.explode(F.sequence("first", F.col("first") + F.col("spread") - 1)).alias("slot"), F.lit(0).alias("kind"), *QV, F.lit(None).cast(ids[2][1]).alias("chunk_id"), F.lit(None).cast(asked_type).alias("asked"), "keys", "weights")
    pairs = among.join(F.broadcast(blocks)).groupBy("chunk_id", block.alias("block"), spread.alias("spread")).agg(F.collect_list(F.struct(*QV)).alias("asked"))
    slot = F.col("block") * F.col("spread") + F.pmod(F.xxhash64("chunk_id"), F.col("spread")).cast("int")
    rows = pairs.join(chunks.select("chunk_id", "keys", "weights"), "chunk_id").select(slot.alias("slot"), F.lit(1).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in ids[:2]], "chunk_id", "asked", "keys", "weights")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_slot, known = None, {}
        for whole in batches:
            slots, kinds = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(slots) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, whole.num_rows], strict=True):
                if lo == hi:
                    continue
                if slots[lo] != at_slot:
                    at_slot, known = slots[lo], {}
                part = whole.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    for q, v, k, w in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(6), part.column(7), strict=True):
                        known[q, v] = (k.values.to_numpy(), w.values.to_numpy())
                elif known:
                    yield scored(part, known)

    def scored(b: pa.RecordBatch, known: dict) -> pa.RecordBatch:
        chunk, lists_, keys, weights = (b.column(i) for i in (4, 5, 6, 7))
        asked = lists_.flatten()
        mine = [known[q] for q in zip(asked.field(0).to_pylist(), asked.field(1).to_pylist(), strict=True)]
        sizes = np.array([len(k) for k, _ in mine], np.int64)
        q_keys, q_weights = (np.concatenate([x[i] for x in mine]) for i in (0, 1))
        own, own_weights = keys.flatten().to_numpy(), weights.flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes)])
        first = np.concatenate([[0], np.cumsum(lists_.value_lengths().to_numpy())])
        at = np.concatenate([[0], np.cumsum(keys.value_lengths().to_numpy())])
        total = np.zeros(len(asked))
        for i in range(b.num_rows):
            here, here_weights = own[at[i] : at[i + 1]], own_weights[at[i] : at[i + 1]]
            if not len(here):
                continue
            lo, hi = ends[first[i]], ends[first[i + 1]]
            place = np.minimum(np.searchsorted(here, q_keys[lo:hi]), len(here) - 1)
            product = np.where(here[place] == q_keys[lo:hi], here_weights[place] * q_weights[lo:hi], 0.0)
            query = np.repeat(np.arange(first[i + 1] - first[i]), sizes[first[i] : first[i + 1]])
            total[first[i] : first[i + 1]] = np.bincount(query, product, first[i + 1] - first[i])
        chunk_ids = chunk.take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(first))))
        keep = pa.array(total != 0)
        return pa.RecordBatch.from_arrays([x.filter(keep) for x in (asked.field(0), asked.field(1), chunk_ids, pa.array(total))], names=[*QV, "chunk_id", name])

    dealt = sides.unionByName(rows).repartition(tasks, "slot").sortWithinPartitions("slot", "kind")
    return dealt.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in ids) + f", {name} double")


def reachable(tokens: DataFrame, index: Index, k: int, seeds: int = 16, ahead: float = 0.6) -> DataFrame:
    """(query_id, variant_no, token, floor, rest, block columns): the blocks that can hold one of the k best of their query.

    A query's tokens are ordered by the most that each adds to any chunk; `below` is what those before a token add at
    most. A chunk is found at the last of its tokens, where it scores at most its part there and `below`. `floor` is a
    score that k chunks are known to reach: the k-th best of the chunks that have the tokens adding most, `seeds` times k
    and one list. Blocks whose max_part and below stay under the floor can't hold a chunk of the k best at its last token;
    of these only those that come to `ahead` of the floor are read, to know more of the chunks that others hold. So the
    tokens that most chunks have are hardly read. rest: the most that an unread block of the token adds, 0 where all are
    read. Tokens without a block that is read stand with nulls, since they may add their rest to any chunk.
    """
    order = Window.partitionBy(*QV)
    rising = order.orderBy("max_part", "token")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = tokens.join(index.tokens.select("token", "df", "n_salts", "max_part"), "token")
    ranked = kept(ranked.withColumn("below", before("max_part", rising)).withColumn("rows_before", before("df", order.orderBy(F.col("max_part").desc(), F.col("token").desc()))))
    early = lists(ranked.where(F.col("rows_before") < seeds * k).select(*QV, "token", "n_salts"), index.postings).select(*QV, "chunk_id").distinct()
    known = top(combined(pair_scores(early, query_side(tokens), index.forward, "bm25")), k)
    floors = known.groupBy(*QV).agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
    slack = F.lit(2 * 10.0**-DIGITS)  # scores are rounded, and sums of doubles depend on their order
    wanted = kept(ranked.join(floors, list(QV), "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - slack).select(*QV, "token", "max_part", "below", "floor"))
    reach = F.col("max_part") + F.col("below") >= F.col("floor") * ahead
    blocks = wanted.where(reach).drop("max_part").join(index.blocks, "token").withColumn("read", reach)
    rest = blocks.groupBy(*QV, "token").agg(F.max(F.when(~F.col("read"), F.col("max_part"))).alias("rest"))
    tokens_ = wanted.select(*QV, "token", "floor", "max_part", reach.alias("reach")).join(rest, [*QV, "token"], "left")
    tokens_ = tokens_.select(*QV, "token", "floor", F.when(F.col("reach"), F.coalesce("rest", F.lit(0.0))).otherwise(F.col("max_part")).alias("rest"))
    return tokens_.join(blocks.where("read").select(*QV, "token", "n", "chunk_ids", "parts"), [*QV, "token"], "left")


def block_topk(tokens: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, variant_no, chunk_id, score, rank): the k best chunks per query by BM25, exactly, from the blocks that reach them.

    What is read of a chunk, and the rest of its query's other tokens, bounds its score; only chunks whose bound reaches
    the floor are scored, from the forward table.
    """
    read = kept(reachable(tokens, index, k))
    bounds = read.select(*QV, "token", "floor", "rest").distinct().groupBy(*QV).agg(F.max("floor").alias("floor"), F.sum("rest").alias("rests"))
    entries = read.where("n is not null").select(*QV, "rest", F.explode(F.arrays_zip("chunk_ids", "parts")).alias("e"))
    most = entries.groupBy(*QV, F.col("e.chunk_ids").alias("chunk_id")).agg(F.sum(F.col("e.parts") - F.col("rest")).alias("more"))
    among = most.join(F.broadcast(bounds), list(QV)).where(F.col("more") + F.col("rests") >= F.col("floor")).select(*QV, "chunk_id")
    return top(combined(pair_scores(among, query_side(tokens), index.forward, "bm25")), k)


def cosine(left: Column, right: Column) -> Column:
    """Dot product of two unit vectors, 0 where one is empty or the lengths differ."""
    dot = F.aggregate(F.zip_with(left, right, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, v: a + v)
    return F.when((F.size(left) > 0) & (F.size(left) == F.size(right)), dot).otherwise(0.0)


def combined(scores: DataFrame, sparse: DataFrame | None = None, dense: DataFrame | None = None, sparse_weight: float = 0.55, dense_weight: float = 1.15) -> DataFrame:
    """(query_id, variant_no, chunk_id, score): the weighted sum of what there is, where above 0."""
    rows, total = scores, F.coalesce("bm25", F.lit(0.0))
    for name, other, weight in (("sparse", sparse, sparse_weight), ("dense", dense, dense_weight)):
        if other is not None:
            rows, total = rows.join(other, [*QV, "chunk_id"], "full"), total + weight * F.coalesce(name, F.lit(0.0))
    return rows.select(*QV, "chunk_id", F.round(total, DIGITS).alias("score")).where("score > 0")


def query_flags(queries: DataFrame, text: Column, rules: Rules) -> DataFrame:
    return queries.select(*QV, rules.flags(text).alias("q_flags"))


def adjusted(scored: DataFrame, q_flags: DataFrame, c_flags: DataFrame | None, factors: Sequence[tuple[int, int, float, float]]) -> DataFrame:
    """scored with score times the factors whose rules fire.

    factors: (query rule, chunk rule, factor if both fire, factor if only the query's does). c_flags: chunk_id, c_flags,
    as the index keeps them; None if scored has them. Patterns run once per query and once per chunk; a pair only looks its flags up.
    """
    rows = scored.join(q_flags, list(QV))
    rows = rows if c_flags is None else rows.join(c_flags, "chunk_id")
    product = F.lit(1.0)
    for q, c, both, alone in factors:
        product = product * F.when(F.array_contains("q_flags", q), F.when(F.array_contains("c_flags", c), both).otherwise(alone)).otherwise(1.0)
    return rows.withColumn("score", F.round(F.col("score") * product, DIGITS)).drop("q_flags", "c_flags").where("score > 0")


def dedup_key(source: Column, section: Column, chunk_type: Column, text: Column) -> Column:
    """What makes two chunks one hit: source, section and type, and for rows and recommendations the text's beginning."""
    mark = F.when(chunk_type.isin("table_row", "recommendation"), F.substring(F.sha1(F.encode(F.substring(text, 1, 500), "UTF-8")), 1, 12)).otherwise("")
    return F.concat_ws("|", source, section, chunk_type, mark)


def best_per_key(scored: DataFrame, key: str = "hit_key", keys: Sequence[str] = QV) -> DataFrame:
    order = Window.partitionBy(*keys, key).orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def top(scored: DataFrame, n: int, keys: Sequence[str] = QV) -> DataFrame:
    """The n best per query, with rank from 1."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "chunk_id"))).where(F.col("rank") <= n)


def variant_size(limit: int) -> int:
    return max(4 * limit, limit + 20)


def balanced(hits: DataFrame, limit: int, quota: int = 2, keys: Sequence[str] = QV, source: str = "source_label") -> DataFrame:
    """At most limit hits per query: first up to quota of each source, sources by their best score, then by score.

    Adds rank, from 1, by score. A query with no more than limit hits keeps all.
    """
    order = [F.col("score").desc(), F.col("chunk_id")]
    rows = hits.withColumn("_all", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    rows = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, source).orderBy(*order)))
    rows = rows.withColumn("_first", F.min("_all").over(Window.partitionBy(*keys, source)))
    early = F.col("_own") <= quota
    turn = F.struct(F.when(early, 0).otherwise(1), F.when(early, F.col("_first")).otherwise(F.col("_all")), F.when(early, F.col("_own")).otherwise(0))
    rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(turn))).where(F.col("_turn") <= limit)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "_turn")))
    return rows.drop("_all", "_own", "_first", "_turn")


def fused(hits: DataFrame, variants: DataFrame, key: str = "hit_key") -> DataFrame:
    """Hits of all variants of a query as one list: score * weight + bonus / (rank + 1), the best per key.

    variants: query_id, variant_no, weight, bonus. Ties go to the earlier variant, then the earlier rank.
    """
    rows = hits.join(variants.select(*QV, "weight", "bonus"), list(QV))
    rows = rows.withColumn("score", F.round(F.col("score") * F.col("weight") + F.col("bonus") / (F.col("rank") + 1), DIGITS))
    order = Window.partitionBy("query_id", key).orderBy(F.col("score").desc(), "variant_no", "rank")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "weight", "bonus")
