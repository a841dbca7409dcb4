"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are fitted: one on target documents, one on the raw text of all documents. A
document's log importance is the sum, over all its n-grams and their repetitions, of the log ratio of target to raw
probability, tempered by length: times sqrt(`length` / number of its words and marks), so that long texts don't lead by
their length. Gumbel noise is added, and the k largest are kept: a draw of k documents without replacement in proportion
to their importance weights.

N-grams are words and runs of ASCII marks (`1 << WORD_BITS` buckets), and pairs of neighbours between white space (`1 <<
PAIR_BITS` buckets; pairs of equal neighbours are told by the power of two of their place in a run of such pairs). Words
and pairs have models of their own. Both count documents, each once for a bucket, so that one document's repetitions don't
pass for many documents. The ratio of a bucket that `own` target documents hold, where `expected` follow from the raw
model, is (own + smooth) / (expected + smooth). Its log counts in proportion to the posterior probability that the ratio differs from 1 at all, at
prior odds of exp(-sure^2 / 2), since the text of a few labelled documents differs from the raw model by chance in most
buckets. Every bucket has its weight; none is left out.

Counts of both models are summed in Spark over all documents. Target documents come from labels: a bounded sample of at
most `max_labels` labelled ids, those of smallest hash, is the only bound here. A fifth of its target documents is held
out; their scores and those of the other labelled documents set the limit that tells them apart best, where a lost share
of target documents counts ten times, and k is the number of all documents at or above it. So k follows the corpus,
while which documents near the limit are among the k is left to the draw.

What reaches the driver and is sent with the tasks: the sample, and one number for each bucket, whatever the corpus.

Null and empty texts have no n-grams and score 0. Null ids take part, with the noise of a null. Rows with equal id and
text tie: all of them stay or go together, so the sample may exceed k by such ties. Without usable labels every
document scores 0 and all stay. Labels may hold nulls, repeats (the worst counts) and unknown ids. An empty document
table gives an empty result. Columns of docs may have any names: the score and key are named around them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import LOWER, PIECE, WORD_BYTES, batch, discard, utf8, written

WORD_BITS, PAIR_BITS = 20, 18
#: Buckets of words and marks, and all buckets; those of pairs come after those of words.
_WORDS = 1 << WORD_BITS
_ALL = _WORDS + (1 << PAIR_BITS)
#: Turns every byte but ASCII marks into a space.
_MARK_BYTES = bytes(b if 0x21 <= b <= 0x7E and not chr(b).isalnum() else 0x20 for b in range(256))
_SAME = np.uint64(0x5BD1E9955BD1E995)


class _Hashes(dict):
    """n-gram -> its 64-bit hash; forgets all when full."""

    def __missing__(self, gram: bytes) -> int:
        h = xxhash.xxh64_intdigest(gram)
        if len(gram) <= 64:
            if len(self) >= 400_000:
                self.clear()
            self[gram] = h
        return h


def _pairs(h: np.ndarray) -> np.ndarray:
    if len(h) < 2:
        return np.zeros(0, np.int64)
    same, at = h[:-1] == h[1:], np.arange(len(h) - 1)
    run = np.where(same, at - np.maximum.accumulate(np.where(same, -1, at)), 1)
    p = np.where(same, _SAME * (np.log2(run).astype(np.uint64) + np.uint64(1)), (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:])
    p = (p ^ (p >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (p >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def grams(text: bytes, known: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's words and marks, and those of its pairs, all with repetitions."""
    parts = (text.translate(WORD_BYTES).split() + text.translate(_MARK_BYTES).split(), text.translate(LOWER).split())
    words, between = (np.fromiter(map(known.__getitem__, part), np.uint64, len(part)) for part in parts)
    return (words >> np.uint64(64 - WORD_BITS)).astype(np.int64), _pairs(between) + _WORDS


def labelled(labels: DataFrame, max_labels: int = 20_000, id_col: str = "doc_id") -> dict[int, bool]:
    """A bounded sample of the labelled ids: whether they are target documents (quality 1, toxic 0)."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    rows = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.min(good.cast("int")).alias("good"))
    return {r[0]: bool(r.good) for r in rows.orderBy(F.xxhash64(id_col), id_col).limit(max_labels).collect()}


def _held_out(key) -> bool:
    return zlib.crc32(str(key).encode()) % 5 == 0


def counts(docs: DataFrame, target: frozenset, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table (gram, raw, own): how many documents, and how many target ones, hold each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _Hashes(), np.zeros((2, _ALL), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE):
                b = whole.slice(at, PIECE)
                for key, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                    found = np.unique(np.concatenate(grams(text, known)))
                    seen[0, found] += 1
                    if key in target:
                        seen[1, found] += 1
        at = np.flatnonzero(seen[0])
        yield batch(gram=pa.array(at.astype(np.int32)), raw=pa.array(seen[0, at]), own=pa.array(seen[1, at]))

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, "gram int, raw long, own long")
    return written(rows.groupBy("gram").agg(F.sum("raw").alias("raw"), F.sum("own").alias("own")))


class Model:
    """The weight of each bucket: the log ratio as far as it counts."""

    def __init__(self, weights: np.ndarray, length: float = 400.0) -> None:
        self.weights, self.length, self.empty = weights, length, not weights.any()

    def score(self, words: np.ndarray, pairs: np.ndarray) -> float:
        if not len(words):
            return 0.0
        return float(self.weights[words].sum() + self.weights[pairs].sum()) * math.sqrt(self.length / len(words))


def fit(counted: DataFrame, smooth: float = 0.1, sure: tuple[float, float] = (3.5, 5.0), length: float = 400.0) -> Model:
    """The model of a table of counts, which has at most a row for each bucket. sure: of words and marks, and of pairs."""
    rows = counted.toArrow()
    gram, raw, own = (rows.column(c).to_numpy() for c in ("gram", "raw", "own"))
    weights = np.zeros(_ALL)
    for mine, odds in ((gram < _WORDS, sure[0]), (gram >= _WORDS, sure[1])):
        if not own[mine].sum():
            continue
        expected = raw[mine] * (own[mine].sum() / raw[mine].sum())
        ratio = np.log((own[mine] + smooth) / (expected + smooth))
        square = (own[mine] - expected) ** 2 / (expected + 1)
        weights[gram[mine]] = ratio / (1 + np.exp(np.minimum(50.0, (odds**2 - square) / 2)))
    return Model(weights, length)


def scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "_score") -> DataFrame:
    """docs, all columns, with score_col: the log importance of the text, 0 without n-grams."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = _Hashes(), sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE):
                b = whole.slice(at, PIECE)
                out = [own.score(*grams(t, known)) if t else 0.0 for t in utf8(b.column(b.schema.get_field_index(text_col)).cast(pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def limit_between(good: list[float], bad: list[float], dear: float = 10.0) -> float:
    """The score that tells the two best, in the middle of the gap: the largest sum of both rates, that of good counted dear times."""
    if not bad:
        return -math.inf
    if not good:
        return math.inf
    points = sorted([(x, 1) for x in good] + [(x, 0) for x in bad])
    best, at, below = -1.0, points[0][0] - 1, [0, 0]
    for (x, kind), (y, _) in zip(points, [*points[1:], (points[-1][0] + 1, 0)], strict=True):
        below[kind] += 1
        rate = below[0] / len(bad) + dear * (1 - below[1] / len(good))
        if y > x and rate > best:
            best, at = rate, (x + y) / 2
    return at


def gumbel(*columns: Column, seed: int = 7) -> Column:
    """Standard Gumbel noise from a hash of the columns: the same on every run and in every task."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def noisy(score: Column, *columns: Column, seed: int = 7) -> Column:
    """score plus noise, as a long in billionths, so that an exact search needs no comparison of doubles."""
    return F.least(F.greatest(F.round((score + gumbel(*columns, seed=seed)) * 1e9), F.lit(-9e18)), F.lit(9e18)).cast("long")


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the long column key, exactly: the range that holds it shrinks by histograms of 4096 counts."""
    row = keys.agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("key").alias("n")).first()
    if not row.n or k < 1 or k > row.n:
        return None
    low, high = row.a, row.b
    while low < high:
        width = (high - low) // 4096 + 1
        slot = F.expr(f"cast((cast(key as decimal(38, 0)) - {low}) div {width} as int)")
        rows = keys.where(F.col("key").between(low, high)).groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
        for r in sorted(rows, key=lambda r: -r.slot):
            if k <= r.n:
                break
            k -= r.n
        low, high = r.a, r.b
    return low


def drawn(table: DataFrame, k: int, key_col: str = "key") -> DataFrame:
    """The rows of the k largest keys (longs), and rows that tie with the last of them."""
    least = kth_largest(table.select(F.col(key_col).alias("key")), k)
    return table.where(F.col(key_col) >= least) if least is not None else table.where(F.lit(k > 0))


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def _resampled(docs: DataFrame, rows: DataFrame, labels: DataFrame, id_col: str, text_col: str, columns: list[str], max_labels: int = 20_000, seed: int = 7) -> tuple[DataFrame, str, str]:
    """The drawn rows' columns with score and key, and the names of these."""
    sample = labelled(labels, max_labels)
    counted = counts(docs, frozenset(k for k, good in sample.items() if good and not _held_out(k)), id_col, text_col)
    model = fit(counted)
    discard(counted)
    score, key = _free("_score", rows.columns), _free("_key", rows.columns)
    table = written(scores(rows, model, text_col, score).withColumn(key, noisy(F.col(score), F.col(id_col), F.xxhash64(F.col(text_col)), seed=seed)).select(*columns, score, key))
    tested = {k: good for k, good in sample.items() if _held_out(k) or not good}
    wanted = docs.sparkSession.createDataFrame([*tested.items()], f"_id {docs.schema[id_col].dataType.simpleString()}, good boolean")
    seen = table.join(F.broadcast(wanted), table[id_col] == wanted["_id"]).select("good", F.col(score).alias("score")).collect() if tested else []  # max_labels ids
    limit = limit_between([r.score for r in seen if r.good], [r.score for r in seen if not r.good]) if not model.empty else -math.inf
    return drawn(table, table.where(F.col(score) >= limit).count(), key), score, key


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id_col, score, key: score plus noise) of the sampled documents."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    table, score, key = _resampled(rows, rows, labels, id_col, text_col, [id_col], **how)
    return table.select(id_col, F.col(score).alias("score"), (F.col(key) / 1e9).alias("key"))


def filtered(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, that are sampled. They are written once with their keys, so no text is shuffled."""
    table, _, _ = _resampled(docs, docs, labels, id_col, text_col, docs.columns, **how)
    return table.select(*docs.columns)
