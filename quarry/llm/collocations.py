"""Phrases whose words stand together more than by chance, by stripes.

A stripe belongs to a prefix of up to three words of a language: an associative counter of the words that follow it. Map
tasks fill stripes of a bounded number of words, merge() adds stripes of equal prefix elementwise, and all figures come
from them: an entry is the count of a phrase, the entries of the empty prefix add up to the number of words, the longest
entry of a prefix and of a suffix tells whether a phrase is only part of longer ones.

Counts are exact. Stripes are made in a pass over the texts for each length of prefix, 0 to 3 words. As no phrase is more
frequent than its parts, a pass leaves out what has a part below `least`. It tells those by a Bloom filter of the
frequent phrases of the pass before. A filter never lets a frequent phrase go, and has at most 2^`MOST_BITS` bits at any
size of the corpus; once it is full, more rare phrases reach the merge, which drops them by their counts.

A stripe of a frequent prefix would be a hot key. Prefixes that begin with a word of a ten-thousandth or more of all words
(ten thousand such words at most, so they are sent to all tasks) are cut into shards by the following word, the empty
prefix always is. Merging sums entries where their shard lies, with Spark's own aggregates, which spill.

Null texts count as empty, null languages as `und`. Texts of any length are read whole; long ones in slices that end where
a piece ends. Repeated rows count each time. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import LOWER, Scratch, utf8

#: Words that a task holds before it hands out stripes, and bytes of text taken at once.
AT_ONCE, SLICE = 1 << 22, 1 << 22
#: Bits of a Bloom filter: per phrase, and at most (as a power of two).
BITS_EACH, MOST_BITS = 16, 28
#: Shards of the empty prefix and of a hot one; a hot word is at least this share of all.
SHARDS, HOT_SHARDS, HOT_SHARE = 1024, 32, 10_000
#: Piece ends become a full stop, which then is in no word; spaces and tabs stay.
_PIECES = bytes(0x2E if chr(LOWER[i]) in ".,;:!?\n\x0b\x0c\r" else LOWER[i] for i in range(256))
#: entries: count, space, word; tabs between entries, which no word has. Far smaller in a shuffle than arrays are.
_SCHEMA = "lang string, prefix string, shard int, entries string"


class _Ids(dict):
    """word -> its number in order of appearance; the end of a piece is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def slices(text: bytes) -> Iterator[bytes]:
    """A text with piece ends as full stops, cut at such after every SLICE bytes."""
    text, at = text.translate(_PIECES), 0
    while at < len(text):
        end = text.find(b".", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(language, words by number, the texts as numbers, 0 at the end of a piece) for about AT_ONCE words at a time."""
    held: dict[str, tuple[_Ids, list[np.ndarray]]] = {}
    size = 0

    def done() -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        for lang, (known, parts) in held.items():
            yield lang, list(known), np.concatenate(parts)
        held.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
            for part in slices(text):
                if lang not in held:
                    held[lang] = (_Ids({b".": 0}), [])
                found = part.replace(b".", b" . ").split()
                held[lang][1].append(np.append(np.fromiter(map(held[lang][0].__getitem__, found), np.int64, len(found)), 0))
                size += len(found) + 1
                if size >= AT_ONCE:
                    yield from done()
                    size = 0
    yield from done()


def hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def gram_hash(parts: list[np.ndarray]) -> np.ndarray:
    """The hashes of phrases whose words have these."""
    out = parts[0]
    for b in parts[1:]:
        h = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15))
        out = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out


class Bloom:
    """A set of hashes: has() is true for all of them, and for few others while it isn't full."""

    PROBES = 4

    def __init__(self, log_bits: int, words: np.ndarray | None = None) -> None:
        self.log_bits, self.words = log_bits, np.zeros(1 << (log_bits - 6), np.uint64) if words is None else words

    def places(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each probe, the words and the bits in them."""
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(self.PROBES):
            at = (h + np.uint64(i) * step) >> np.uint64(64 - self.log_bits) if i % 2 else (h + np.uint64(i) * step) & np.uint64((1 << self.log_bits) - 1)
            yield (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for word, bit in self.places(h):
            out &= (self.words[word] & bit) != 0
        return out


def bloom(phrases: DataFrame, n: int) -> Bloom:
    """The filter of n phrases (lang, phrase), of as many words each, made in Spark: tasks OR their bits, and the words come."""
    own = Bloom(min(MOST_BITS, max(16, (BITS_EACH * max(1, n) - 1).bit_length())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list[list[bytes]]] = {}
            for lang, phrase in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                found.setdefault(lang, []).append(phrase.split(b" "))
            for lang, several in found.items():
                places = [*own.places(gram_hash([hashes(lang, [w[i] for w in several]) for i in range(len(several[0]))]))]
                at, bits = np.concatenate([p[0] for p in places]), np.concatenate([p[1] for p in places])
                order = np.argsort(at, kind="stable")
                at, bits = at[order], bits[order]
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array(np.bitwise_or.reduceat(bits, first).view(np.int64))], names=["at", "bits"])

    rows = phrases.select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    own.words[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return own


def stripes(lang: str, prefix_of: np.ndarray, prefixes: pa.Array, shard: np.ndarray, next_of: np.ndarray, words: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """Entries (number of the prefix, shard, number of the next word, count) as a row per prefix and shard."""
    order = np.lexsort((shard, prefix_of))
    p, s = prefix_of[order], shard[order]
    first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (s[1:] != s[:-1])]) if len(p) else np.zeros(0, np.int64)
    ends = pa.array(np.append(first, len(p)).astype(np.int32))
    each = pc.binary_join_element_wise(pa.array(counts[order]).cast(pa.string()), words.take(pa.array(next_of[order])), " ")
    columns = [pa.array([lang] * len(first), pa.string()), prefixes.take(pa.array(p[first])), pa.array(s[first].astype(np.int32)), pc.binary_join(pa.ListArray.from_arrays(ends, each), "\t")]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "prefix", "shard", "entries"])


def _texts(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _shards(words: list[bytes], n: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % n for w in words), np.int64, len(words))


def word_stripes(lang: str, words: list[bytes], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The stripe of the empty prefix: how often each word occurs."""
    counts = np.bincount(ids, minlength=len(words))[1:]
    n = len(counts)
    if n:
        yield stripes(lang, np.zeros(n, np.int64), pa.array([""]), _shards(words[1:], SHARDS), np.arange(1, n + 1), _texts(words), counts)


def longer_stripes(lang: str, words: list[bytes], ids: np.ndarray, m: int, frequent: Bloom, hot: frozenset[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """The stripes of m words where they, and the last m of them and the next, may both be frequent."""
    if len(ids) <= m:
        return
    h, n = hashes(lang, words), len(ids) - m + 1
    may = np.logical_and.reduce([ids[i : n + i] > 0 for i in range(m)])
    if m == 1:
        may &= frequent.has(h)[ids]
    else:
        at = np.flatnonzero(may)
        may[at] = frequent.has(gram_hash([h[ids[at + i]] for i in range(m)]))
    at = np.flatnonzero(may[:-1] & may[1:])
    if not len(at):
        return
    text = _texts(words)
    first, prefixes, place = np.arange(len(words)), text, ids[at]
    for i in range(1, m):
        code, place = np.unique(place << 32 | ids[at + i], return_inverse=True)
        first, prefixes = first[code >> 32], pc.binary_join_element_wise(prefixes.take(pa.array(code >> 32)), text.take(pa.array(code & 0xFFFFFFFF)), " ")
    code, counts = np.unique(place << 32 | ids[at + m], return_counts=True)
    p, last = code >> 32, code & 0xFFFFFFFF
    is_hot = np.fromiter(((lang, w) in hot for w in words), bool, len(words))
    yield stripes(lang, p, prefixes, np.where(is_hot[first][p], 1 + _shards(words, HOT_SHARDS)[last], 0), last, text, counts)


def merged(docs: DataFrame, make: Callable[[str, list[bytes], np.ndarray], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(lang, prefix, word, f): the stripes of all tasks, added elementwise where their prefix and shard lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids in numbered(batches):
            yield from make(lang, words, ids)

    dealt = docs.mapInArrow(run, _SCHEMA).repartition("lang", "prefix", "shard")
    each = dealt.select("lang", "prefix", "shard", F.explode(F.split("entries", "\t", -1)).alias("e"))
    each = each.select("lang", "prefix", "shard", F.expr("substring(e, instr(e, ' ') + 1)").alias("word"), F.substring_index("e", " ", 1).cast("long").alias("n"))
    return each.groupBy("lang", "prefix", "shard", "word").agg(F.sum("n").alias("f")).drop("shard")


def phrase_counts(docs: DataFrame, least: int, scratch: Scratch, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, m: words, f) of all phrases of 1 to 4 words seen `least` times, (lang, n: words))."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = scratch.written(merged(rows, word_stripes).select("lang", "word", "f"))
    totals = scratch.written(words.groupBy("lang").agg(F.sum("f").alias("n")))
    every = totals.agg(F.sum("n")).first()[0] or 0
    ones = scratch.written(words.where(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("m"), "f"))
    hot = frozenset((r.lang, r.phrase.encode()) for r in ones.where(F.col("f") * HOT_SHARE >= every).collect())  # HOT_SHARE words at most
    every_m = [ones]
    for m in (1, 2, 3):
        frequent = docs.sparkSession.sparkContext.broadcast(bloom(every_m[-1], every_m[-1].count()))
        more = merged(rows, lambda *x, m=m, frequent=frequent: longer_stripes(*x, m, frequent.value, hot)).where(F.col("f") >= least)
        every_m.append(scratch.written(more.select("lang", F.concat_ws(" ", "prefix", "word").alias("phrase"), F.lit(m + 1).alias("m"), "f")))
    return reduce(DataFrame.unionByName, every_m), totals


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `most` phrases of 2 to 4 words.

    a, l and r count the phrase and the two parts of the cut of lowest score, floor(2000000 a / (l + r)). Phrases whose
    words stand in a longer one of at least `least` and four fifths of their count are left out.
    """
    scratch = Scratch()
    counts, totals = phrase_counts(docs, least, scratch, lang_col, text_col)
    counts = scratch.written(counts)
    found = counts.where("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("w"))
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")

    # the longest entry of each prefix, and of each suffix; a longer phrase counts through the parts that it has
    longer = found.where("m > 2").select("lang", "a", F.explode(F.array(part(1, F.col("m") - 1), part(2, F.col("m") - 1))).alias("phrase"))
    longer = scratch.written(longer.groupBy("lang", "phrase").agg(F.max("a").alias("most")))
    big = lambda c: F.col(c).cast("decimal(20, 0)")
    free = found.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (big("most") * 100 < big("a") * 80)).drop("most")

    cuts = F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", 1, k), " ").alias("first"), F.array_join(F.slice("w", k + 1, F.col("m") - k), " ").alias("rest")))
    cut = free.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.k", F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("c.first").alias("p")), F.struct(F.lit("r").alias("side"), F.col("c.rest").alias("p")))).alias("x"))
    cut = scratch.written(cut.select("lang", "phrase", "a", "k", "x.side", "x.p"))
    sides = cut.join(counts.select("lang", F.col("phrase").alias("p"), "f"), ["lang", "p"])
    sides = sides.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = sides.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    ranked = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")))
    return scratch.last(ranked.where(F.col("rank") <= most).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
