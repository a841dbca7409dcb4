"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are lower-cased and cut into words; every run of `size` consecutive words is a pattern, and an item of
fewer words is one pattern. One automaton holds all patterns, over two letters for each word instead of its characters.
Each document is normalised the same way and scanned once; a match is turned into word places, which mark the hit words,
and into character offsets of the original text.

The automaton's size follows the benchmark, not the documents. Spark estimates its bytes before any item is fetched; a
benchmark over `most_bytes` is cut by item into automata of that size (or of one item). These are sent, used and dropped
one after the other, each in a pass of its own over the documents, so a worker never holds two, and no limit drops an
item. Each pass writes what it finds; what the passes found of a text is joined afterwards.

Null texts have no words: as documents they have no hits, as items no pattern. Null item ids stand as "". An empty
benchmark gives documents without hits, an empty document table an empty result. Repeated rows give repeated results;
equal items all count. Documents of any length are scanned whole. Only the named columns are read, so others may have any
name.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import LOWER, Scratch, batch, map_batches, utf8, words

#: Bytes that a node of the automaton takes, and the largest automaton that a worker holds.
NODE_BYTES, MOST_BYTES = 40, 200 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_NUMBER = count()
#: Two letters from separate ranges stand for a word, so that no match begins inside one.
_SECOND = 256
_UNKNOWN = chr(0) + chr(_SECOND)


class Automaton:
    """Of the windows of (item id, text) pairs."""

    def __init__(self, items: list[tuple[str, str]], size: int) -> None:
        self.machine, self.letters = ahocorasick.Automaton(ahocorasick.STORE_INTS), {}
        self.ids = [item for item, _ in items]
        self.owners: list[int | set[int]] = []  # per window, the item or items that hold it
        for number, (_, text) in enumerate(items):
            own = [self._letters(w) for w in words((text or "").encode())]
            for i in range(max(1, len(own) - size + 1) if own else 0):
                window = "".join(own[i : i + size])
                at = self.machine.get(window, -1)
                if at < 0:
                    self.machine.add_word(window, len(self.owners))
                    self.owners.append(number)
                elif self.owners[at] != number:
                    held = self.owners[at]
                    self.owners[at] = (held if isinstance(held, set) else {held}) | {number}
        self.empty = not self.owners
        if not self.empty:
            self.lengths = np.zeros(len(self.owners), np.int32)
            for window, at in self.machine.items():
                self.lengths[at] = len(window) // 2
            self.machine.make_automaton()

    def _letters(self, word: bytes) -> str:
        found = self.letters.get(word)
        if found is None:
            n = len(self.letters) + 1
            high = n >> 8  # letters below _SECOND and from _SECOND + 256 on are first ones
            found = self.letters[word] = chr(high if high < _SECOND else high + 256 + (0x900 if high + 256 >= 0xD000 else 0)) + chr(_SECOND + (n & 255))
        return found

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Of a document's words: the runs (first, end) that a window covers, overlaps joined, and the items."""
        if self.empty or not found:
            return [], set()
        get = self.letters.get
        runs: list[tuple[int, int]] = []
        windows = set()
        for last, at in self.machine.iter("".join([get(w, _UNKNOWN) for w in found])):
            windows.add(at)
            runs.append(((last + 1) // 2 - int(self.lengths[at]), (last + 1) // 2))
        items: set[int] = set()
        for at in windows:
            held = self.owners[at]
            items |= held if isinstance(held, set) else {held}
        return joined(runs), {self.ids[i] for i in items}


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (first, end) in order, with those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class _Sent:
    """A broadcast shard of the benchmark, built into an automaton once per Python worker."""

    def __init__(self, rows: DataFrame, size: int) -> None:
        self.number, self.size = next(_NUMBER), size
        self.sent = rows.sparkSession.sparkContext.broadcast([(r.id, r.text) for r in rows.select("id", "text").collect()])

    def automaton(self) -> Automaton:
        return _built(self)

    def __hash__(self) -> int:
        return self.number

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Sent) and self.number == other.number


@lru_cache(maxsize=1)
def _built(sent: _Sent) -> Automaton:
    return Automaton(sent.sent.value, sent.size)


def shards(benchmark: DataFrame, id_col: str, text_col: str, size: int, most_bytes: int) -> list[DataFrame]:
    """The benchmark's items (id, text), cut so that the automaton of each part takes about most_bytes (or is of one item)."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = F.size(F.split("text", "[^0-9A-Za-z\\x80-\\x{10FFFF}]+")).cast("long")
    total = rows.agg(F.sum(F.greatest(n - size + 1, F.lit(1)) * F.least(n, F.lit(size)) * 2 * NODE_BYTES).alias("bytes")).first().bytes or 0
    parts = -(-total // most_bytes) or 1
    return [rows] if parts == 1 else [rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k) for k in range(parts)]


def _spans(text: bytes, runs: list[tuple[int, int]]) -> list[list[int]]:
    """Code point offsets (start, end) in the original text of runs of words."""
    if not runs:
        return []
    at = [m.span() for m in _WORD.finditer(text.translate(LOWER))]
    return [[len(text[: at[a][0]].decode()), len(text[: at[b - 1][1]].decode())] for a, b in runs]


def scan(text: bytes, machine: Automaton | None) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words, hit runs of words and the sorted items of a text."""
    found = words(text)
    runs, items = machine.scan(found) if machine else ([], set())
    return len(found), runs, sorted(items)


_FOUND = "n_words long, runs array<array<bigint>>, spans array<array<bigint>>, items array<string>"


def _pass(rows: DataFrame, kind: str, sent: _Sent | None, only_hits: bool) -> DataFrame:
    """rows (id, text_hash, text) scanned with one automaton, or with none; only_hits: without the texts it doesn't hit."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        machine = sent.automaton() if sent else None
        texts = utf8(b.column(2))
        done = [scan(t, machine) for t in texts]
        pairs = pa.list_(pa.list_(pa.int64()))
        out = batch(
            id=b.column(0), text_hash=b.column(1), n_words=pa.array([n for n, _, _ in done], pa.int64()), runs=pa.array([[list(x) for x in r] for _, r, _ in done], pairs),
            spans=pa.array([_spans(t, r) for t, (_, r, _) in zip(texts, done, strict=True)], pairs), items=pa.array([i for _, _, i in done], pa.list_(pa.string())),
        )
        return out.filter(pa.array([bool(r) for _, r, _ in done], pa.bool_())) if only_hits else out

    return map_batches(rows, f"id {kind}, text_hash long, {_FOUND}", run)


def _together(rows: DataFrame, kind: str) -> DataFrame:
    """rows (id, text_hash, n_words, lists of runs, spans and items, one of each per automaton) with each list as one."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        runs, spans, items = ([x or [] for x in b.column(i).to_pylist()] for i in (3, 4, 5))
        done = [joined([tuple(x) for part in row for x in part]) for row in runs]
        begins = [{r[0]: s[0] for p, q in zip(x, y, strict=True) for r, s in zip(p, q, strict=True)} for x, y in zip(runs, spans, strict=True)]
        ends = [{r[1]: s[1] for p, q in zip(x, y, strict=True) for r, s in zip(p, q, strict=True)} for x, y in zip(runs, spans, strict=True)]
        pairs = pa.list_(pa.list_(pa.int64()))
        return batch(
            id=b.column(0), text_hash=b.column(1), n_words=b.column(2), runs=pa.array([[list(x) for x in r] for r in done], pairs),
            spans=pa.array([[[begins[k][x], ends[k][y]] for x, y in r] for k, r in enumerate(done)], pairs), items=pa.array([sorted({i for part in row for i in part}) for row in items], pa.list_(pa.string())),
        )

    return map_batches(rows, f"id {kind}, text_hash long, {_FOUND}", run)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 10, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Per row of docs: id_col, n_words, n_hit, items (sorted ids), spans (start and end of hit passages), contaminated."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    kind, parts = docs.schema[id_col].dataType.simpleString(), shards(benchmark, "item_id", "text", size, most_bytes)
    if len(parts) == 1:
        found = _pass(rows, kind, _Sent(parts[0], size), False)
    else:
        scratch, hits = Scratch(), None
        for part in parts:
            sent = _Sent(part, size)
            one = scratch.written(_pass(rows, kind, sent, True).dropDuplicates(["id", "text_hash"]))
            sent.sent.destroy()
            hits = one if hits is None else hits.union(one)
        lists = hits.groupBy("id", "text_hash").agg(*[F.collect_list(c).alias(c) for c in ("runs", "spans", "items")])  # one entry per part
        own = _pass(rows, kind, None, False).select("id", "text_hash", "n_words")
        same = own["id"].eqNullSafe(lists["id"]) & (own["text_hash"] == lists["text_hash"])
        found = scratch.last(_together(own.join(lists, same, "left").select(own["id"], own["text_hash"], "n_words", "runs", "spans", "items"), kind))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return found.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "items", "spans", (F.size("runs") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = 10, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of docs, all columns, whose text holds no window of the benchmark; nothing is shuffled.

    With more than one automaton, what each pass keeps is written for the next one.
    """
    scratch, parts = Scratch(), shards(benchmark, "item_id", "text", size, most_bytes)
    for k, part in enumerate(parts):
        sent = _Sent(part, size)

        def run(b: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            machine = sent.automaton()
            clean = [not scan(t, machine)[1] for t in utf8(b.column(b.schema.get_field_index(text_col)))]
            return b.filter(pa.array(clean, pa.bool_()))

        kept = map_batches(docs, docs.schema, run)
        if len(parts) == 1:
            return kept
        docs = scratch.written(kept) if k < len(parts) - 1 else scratch.last(kept)
        sent.sent.destroy()
    return docs


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
