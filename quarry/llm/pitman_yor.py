"""Language-model scores by a hierarchical Pitman-Yor process, its Chinese restaurants seated by Gibbs sampling.

Every word has a restaurant: the customers of `u` are the words that follow u in training texts (the end of a text is the empty
word, which also stands before the first one). A table opened there sends its word to the restaurant of all words, and a table
opened in that sends the spelling of its word down to a hierarchy of restaurants of bytes. Their contexts are the low five bits
of up to three bytes before (which tell letters apart); a restaurant's parent is that of the context without its first byte,
down to the empty context over the uniform distribution of 256 bytes and the word's end. Words never seen in training are one
event, as in the base score; its probability is that of a new table with a spelling that is none of theirs.

A sweep goes from the longest contexts to the empty one: pairs of words, words, bytes. It takes all customers of a dish out of a
restaurant and seats them anew. What they do elsewhere depends on the number of their tables alone, so that is drawn from its
posterior (generalised Stirling numbers: exact up to `EXACT` customers, by their saddle point beyond). A dish with one customer
has one table. Within a restaurant, the tables of other dishes count as they were when the sweep began, which lets Spark seat
dishes in parallel. After `burn` sweeps, the predictive probabilities of `samples` sweeps are averaged.

Texts become chunks of a bounded number of tokens: their words, and a number for each token. Chunks send their words, and the
pairs of words in them, to parts by the word's or the first word's hash, in one packed row for each chunk and part; parts count
them, and remember where each chunk's entries went. In a sweep, parts of pairs and of words exchange tables and probabilities;
then both send prices to the chunks, whose tokens add them up. The number of parts grows with the corpus. Words are told apart
by 64-bit hashes. Numbers travel by places of bytes, compressed, since most are small; shuffles go when their table is written.
Only the byte model goes to all tasks: at most 32^3 contexts of 257 symbols, whatever the corpus.

Null texts count as empty: one token, the end. A null id counts as an empty text, whose remainder is 0, so it is held out.
Repeated rows are scored each, and learned from each. Without training documents all words are one event. An empty table
gives an empty result. Long texts are read in slices. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from quarry.llm.shared import LOWER, PIECE, Scratch, batch, brief_shuffles, utf8

SYMBOLS, END, DEPTH, CLASS = 257, 256, 3, 32
#: Tokens of a chunk, bytes of text taken at once, tokens for each part of words and pairs.
AT_ONCE, SLICE, PART = 1 << 22, 1 << 22, 1 << 20
#: Customers of a dish up to which numbers of tables have exact weights; customers that reseated() moves.
EXACT, MOVES = 1024, 64
GOLD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = re.compile(rb"[ \t-\r]")


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """n[i] numbers between 0 and 1 for each key, one after another: the same for a key and seed wherever they are drawn."""
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        x = np.repeat(keys.view(np.uint64), n) + at.astype(np.uint64) * GOLD + np.uint64(seed * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)
    return (mixed(x) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def first_seating(c: int, outside: float, share: float, d: float, draw: Iterator[float]) -> list[int]:
    """Table sizes of c customers as is typical for many: a negative binomial number of tables, all but one of them small."""
    few = min((outside / d + 1) * share / max(1e-9, 1 - share), c - 1.0)
    small = min(c - 1, int(few + next(draw)))
    out = []
    for _ in range(min(small, 4096)):
        size = int(max(1e-12, next(draw)) ** (-1 / d))
        if size < c:
            out.append(size)
            c -= size
    return [*out, c]


def seat(sizes: list[int], outside: float, share: float, d: float, u: float) -> None:
    """One more customer: at a new table, or at one of sizes. outside: concentration and discounts of other dishes' tables."""
    new = (outside + d * len(sizes)) * share
    x = u * (new + sum(sizes) - d * len(sizes)) - new
    if x < 0 or not sizes:
        sizes.append(1)
        return
    for k, s in enumerate(sizes):
        x -= s - d
        if x < 0:
            break
    sizes[k] += 1


def leave(sizes: list[int], u: float) -> None:
    """One customer, each as likely, goes; an empty table closes."""
    x = u * sum(sizes)
    for k, s in enumerate(sizes):
        x -= s
        if x < 0:
            break
    sizes[k] -= 1
    if not sizes[k]:
        sizes[k] = sizes[-1]
        sizes.pop()


def reseated(sizes: list[int], c: int, outside: float, share: float, d: float, draw: Iterator[float]) -> list[int]:
    """The seating of a dish that now has c customers: those that came or went, and then a sweep."""
    if abs(c - sum(sizes)) > MOVES or not sizes:
        sizes = first_seating(c, outside, share, d, draw)
    while sum(sizes) > c:
        leave(sizes, next(draw))
    while sum(sizes) < c:
        seat(sizes, outside, share, d, next(draw))
    if c > 1:
        for _ in range(min(c, MOVES)):
            leave(sizes, next(draw))
            seat(sizes, outside, share, d, next(draw))
    return sizes


_STIRLING: dict[float, np.ndarray] = {}


def stirling_logs(d: float) -> np.ndarray:
    """[c, t]: logs of the generalised Stirling numbers, by which c customers of a dish sit at t tables; kept for the last discounts."""
    if d not in _STIRLING:
        if len(_STIRLING) > 1:
            _STIRLING.pop(next(iter(_STIRLING)))
        out = np.full((EXACT + 1, EXACT + 1), -np.inf)
        out[1, 1] = 0.0
        t = np.arange(1, EXACT + 1)
        for c in range(2, EXACT + 1):
            own = t[:c]
            out[c, 1 : c + 1] = np.logaddexp(out[c - 1, :c], out[c - 1, 1 : c + 1] + np.log(np.maximum(1e-300, c - 1 - d * own)))
        _STIRLING[d] = out
    return _STIRLING[d]


def gamma_logs(x: np.ndarray) -> np.ndarray:
    """Logs of the gamma function of positive numbers."""
    x = np.asarray(x, np.float64)
    low = np.where(x < 8, x, 1.0)
    small = np.log(low * (low + 1) * (low + 2) * (low + 3)) + np.log((low + 4) * (low + 5) * (low + 6) * (low + 7))
    y = np.where(x < 8, x + 8, x)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - 1 / 1260 / y**2) / y**2) / y - np.where(x < 8, small, 0.0)


def table_size(x: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """At z = 1 - exp(-x): g = 1 - (1 - z)^d, and z g' / g, the mean size of a table there."""
    g = -np.expm1(-d * x)
    return g, d * -np.expm1(-x) * np.exp(x * (1 - d)) / g


def saddle_logs(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """stirling_logs() of many customers: c! / (t! d^t) times the coefficient of z^c in g(z)^t. While tables are few for so many
    customers by its sum over powers of (1 - z)^d, where little cancels; then by the saddle point, joined to it."""

    def saddle(c: np.ndarray, t: np.ndarray) -> np.ndarray:
        low, high = np.full(c.shape, 1e-9), np.full(c.shape, 60.0 / (1 - d) + 1)
        for _ in range(45):
            x = np.sqrt(low * high)
            more = table_size(x, d)[1] < c / t
            low, high = np.where(more, x, low), np.where(more, high, x)
        g, m = table_size(x, d)
        z, rest = -np.expm1(-x), np.exp(-x)
        spread = m * (1 + z * (1 - d) / rest - m)
        return gamma_logs(c + 1) - gamma_logs(t + 1) - t * math.log(d) + t * np.log(g) - c * np.log(z) - 0.5 * np.log(2 * np.pi * np.maximum(1e-300, t * spread))

    def powers(c: np.ndarray, t: np.ndarray) -> np.ndarray:
        total, choose = np.zeros(t.shape), np.ones(t.shape)
        for j in range(1, 41):
            choose = choose * (t - j + 1) / -j
            if abs(j * d - round(j * d)) > 1e-12:
                total += choose / math.gamma(-j * d) * np.exp(gamma_logs(c - j * d) - gamma_logs(c - d))
        return np.log(np.maximum(1e-300, total)) + gamma_logs(c - d) - gamma_logs(t + 1) - t * math.log(d)

    c, t = np.asarray(c, np.float64), np.asarray(t, np.float64)
    few = np.floor(np.clip((3 / ((1 - d) * d ** (d / (1 - d)))) ** (1 - d) * c**d, 8, c / 2))
    own = np.broadcast_to(c, t.shape)
    return np.where(t <= few, powers(c, np.minimum(t, few)), saddle(own, np.minimum(t, own - 1e-3)) + (powers(c, few) - saddle(c, few)))


def many_tables(c: np.ndarray, outside: np.ndarray, share: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """table_counts() of dishes of more than EXACT customers: from a grid of numbers of tables about the likeliest."""
    low, high = np.full(len(c), 1e-9), np.full(len(c), 60.0 / (1 - d) + 1)
    for _ in range(60):  # where one more table makes no difference
        x = np.sqrt(low * high)
        g, m = table_size(x, d)
        more = g * share * (outside + d * c / m) * m < d * c
        low, high = np.where(more, x, low), np.where(more, high, x)
    best = np.clip(c / table_size(x, d)[1], 1, c)
    step = np.ceil(12 * np.sqrt(best + 4) / 64)
    first = np.maximum(1, np.floor(best - 32 * step))
    t = first[:, None] + step[:, None] * np.arange(64)
    inside = t <= c[:, None]
    t = np.where(inside, t, c[:, None])
    logs = saddle_logs(c[:, None], t, d) + gamma_logs(outside[:, None] / d + t) + t * np.log(d * share)[:, None]
    logs = np.where(inside, logs, -np.inf)
    weights = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
    at = u * weights[:, -1]
    k = np.minimum((weights <= at[:, None]).sum(axis=1), 63)
    before = np.where(k > 0, weights[np.arange(len(c)), np.maximum(0, k - 1)], 0.0)
    within = (at - before) / np.maximum(1e-300, weights[np.arange(len(c)), k] - before)
    return np.clip(first + step * k + np.floor(within * step) - (step - 1) // 2, 1, c).astype(np.int64)


def table_counts(keys: np.ndarray, c: np.ndarray, outside: np.ndarray, share: np.ndarray, d: float, seed: int) -> np.ndarray:
    """Tables of many dishes of c customers, all seated anew: t has the weight S_d(c, t) (outside | d)_t share^t.
    outside: the restaurant's concentration and the discounts of its other dishes' tables."""
    t = np.minimum(c, 1).astype(np.int64)
    u, share = uniform(keys, np.ones(len(keys), np.int64), seed), np.maximum(share, 1e-300)
    order = np.argsort(c, kind="stable")
    sizes, begins = np.unique(c[order], return_index=True)
    for size, begin, end in zip(sizes.tolist(), begins.tolist(), [*begins.tolist()[1:], len(c)][: len(sizes)], strict=True):
        if not 1 < size <= EXACT:
            continue
        row, n = stirling_logs(d)[size, 1 : size + 1], np.arange(size)
        for at in range(begin, end, max(1, (1 << 18) // size)):
            mine = order[at : min(end, at + max(1, (1 << 18) // size))]
            logs = np.cumsum(np.log((outside[mine, None] + d * n) * share[mine, None]), axis=1) + row
            weights = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
            t[mine] = 1 + np.minimum((weights <= (u[mine] * weights[:, -1])[:, None]).sum(axis=1), size - 1)
    many = order[np.searchsorted(c[order], EXACT, "right") :]
    for at in range(0, len(many), 2048):
        mine = many[at : at + 2048]
        t[mine] = many_tables(c[mine].astype(np.float64), outside[mine], share[mine], d, u[mine])
    return t


@dataclass
class Spelling:
    """The restaurants of bytes: per depth, keys (context * 257 + symbol), customers, tables, and the discount."""

    keys: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0, np.int64)] * (DEPTH + 1))
    customers: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0, np.int64)] * (DEPTH + 1))
    tables: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0, np.int64)] * (DEPTH + 1))
    discounts: tuple[float, ...] = (0.5,) * (DEPTH + 1)
    strength: float = 1.0

    def open_tables(self, depth: int) -> np.ndarray:
        return np.bincount(self.keys[depth] // SYMBOLS, self.tables[depth], CLASS**depth)

    def predicted(self, depth: int) -> np.ndarray:
        """The probability of each symbol in each context of a depth; of depth -1, the uniform one."""
        p = np.full((1, SYMBOLS), 1 / SYMBOLS)
        for k in range(depth + 1):
            p = np.tile(p, (CLASS if k else 1, 1))
            where, symbol = np.divmod(self.keys[k], SYMBOLS)
            d = self.discounts[k]
            p *= (self.strength + d * self.open_tables(k))[:, None]
            p[where, symbol] += self.customers[k] - d * self.tables[k]
            p /= (self.strength + np.bincount(where, self.customers[k], CLASS**k))[:, None]
        return p

    def log_table(self) -> np.ndarray:
        """Natural logs for the deepest contexts, by key; kept for the tasks of a worker."""
        if not hasattr(self, "_log"):
            p = self.predicted(DEPTH)
            self._log = np.log(p, out=p).ravel().astype(np.float32)
        return self._log


def raw(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of a binary column, one after another, and each row's number of them."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2] if len(column) else None
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if data is not None and ends[-1] > ends[0] else np.zeros(0, kind)
    return values, np.diff(ends).astype(np.int64) // np.dtype(kind).itemsize


def binary(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column of rows of so many values."""
    ends = np.concatenate([[0], np.cumsum(lengths)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


def lettered(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of all words, an END after each word, and where each word begins."""
    letters, lengths = raw(words.cast(pa.binary()), np.uint8)
    ends = np.cumsum(lengths + 1) - 1
    symbols = np.full(len(letters) + len(lengths), END, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = letters
    return symbols, np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys at the deepest contexts of all symbols of all words, and where each word begins."""
    symbols, starts = lettered(words)
    begins = np.zeros(len(symbols), bool)
    begins[starts] = True
    context, before = np.zeros(len(symbols), np.int64), symbols % CLASS
    for i in range(DEPTH):
        before = np.where(begins, 0, np.concatenate([[0], before[:-1]]))
        context += before * CLASS**i
    return context * SYMBOLS + symbols, starts


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words: a number for each place and byte, added up and mixed."""
    out = [np.zeros(0, np.uint64)]
    for at in range(0, len(words), 1 << 14):
        symbols, starts = lettered(words.slice(at, 1 << 14))
        place = np.arange(len(symbols)) - np.repeat(starts, np.diff(np.append(starts, len(symbols))))
        with np.errstate(over="ignore"):
            out.append(mixed(np.add.reduceat(mixed((place * SYMBOLS + symbols + 1).astype(np.uint64) * GOLD), starts)))
    return np.concatenate(out)


class _Ids(dict):
    """word -> its number in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def squeezed(values: np.ndarray) -> bytes:
    """An array in few bytes: the lowest bytes of all its values, then the next ones, and so on, compressed behind their number.
    Memory comes from the system, which gets it back at once; Arrow's own pool would keep much of it in a worker."""
    places = np.ascontiguousarray(np.ascontiguousarray(values).ravel().view(np.uint8).reshape(-1, values.itemsize).T)
    return len(places[0]).to_bytes(8, "little") + pa.compress(pa.py_buffer(places), codec="zstd", asbytes=True, memory_pool=pa.system_memory_pool())


def opened(data: bytes | pa.Buffer, kind: type) -> np.ndarray:
    """The values of squeezed()."""
    data = pa.py_buffer(data)
    n, size = int.from_bytes(data[:8].to_pybytes(), "little"), np.dtype(kind).itemsize
    places = np.frombuffer(pa.decompress(data.slice(8), decompressed_size=n * size, codec="zstd", memory_pool=pa.system_memory_pool()), np.uint8)
    return np.ascontiguousarray(places.reshape(size, n).T).view(kind).ravel()


STEP, TIMES = 65535, 255


def packed(rows: np.ndarray, docs: np.ndarray, times: np.ndarray, n_rows: int, first: int) -> tuple[pa.Array, pa.Array]:
    """Postings, sorted by row and document, as two binary columns: steps from document to document (from `first`), in 16
    bits, and times in 8 bits. Longer steps go by entries of 0 times, larger times over several entries."""
    begins = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
    step = np.where(begins, docs - first, np.diff(docs, prepend=first))
    far, pieces = step // STEP, (times + TIMES - 1) // TIMES
    size = far + pieces
    at = np.cumsum(size) - size + far
    steps, counts = np.zeros(int(size.sum()), np.uint16), np.full(int(size.sum()), TIMES, np.uint8)
    steps[at] = step - far * STEP
    counts[at + pieces - 1] = times - TIMES * (pieces - 1)
    skips = np.repeat(at - far, far) + np.arange(int(far.sum())) - np.repeat(np.cumsum(far) - far, far)
    steps[skips], counts[skips] = STEP, 0
    lengths = np.bincount(rows, size, n_rows).astype(np.int64)
    return binary(steps, lengths), binary(counts, lengths)


def unpacked(steps: pa.Array, counts: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries of each row, documents, times) of packed() columns."""
    moved, lengths = raw(steps, np.uint16)
    place = np.cumsum(moved.astype(np.int64))
    begin = np.cumsum(lengths) - lengths
    before = np.concatenate([[0], place])[begin]
    return lengths, place + np.repeat(first - before, lengths), raw(counts, np.uint8)[0].astype(np.int64)


def spelling_logs(model: Spelling, words: pa.Array) -> np.ndarray:
    keys, starts = spelled(words)
    return np.add.reduceat(model.log_table()[keys].astype(np.float64), starts) if len(starts) else np.zeros(0)


def discount(ones: int | None, twos: int | None) -> float:
    """The usual estimate from how many dishes have one and two customers."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones or twos else 0.5


def listed(words: bytes) -> list[bytes]:
    return words.split(b"\n")


def rows_of(schema: pa.Schema, rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


def chunks(docs: DataFrame, id_col: str, text_col: str, remainders: int = 10) -> DataFrame:
    """Rows of two kinds. Documents: pid, n (its number in task pid), doc_id, held_out, n_tokens. Chunks of about AT_ONCE tokens:
    chunk, its words (the end of a text first), ids (a word's number for each token), and for the documents of task pid from
    number n on how many of the tokens they have (lengths) and whether they are learned from; before: what precedes the first token."""
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, n, start, chunk, before, size = TaskContext.get().partitionId(), 0, 0, 0, 0, 0
        known, ids, lengths, learned, doc_type = _Ids({b"": 0}), [], [], [], None

        def written() -> pa.RecordBatch:
            cells = [b"\n".join(known), squeezed(np.concatenate(ids)), np.array(lengths, np.int32).tobytes(), np.array(learned, np.uint8).tobytes()]
            words, tokens, many, which = (pa.array([x], pa.binary()) for x in cells)
            return batch(pid=pa.array([pid], pa.int32()), n=pa.array([start], pa.int32()), doc_id=pa.nulls(1, doc_type), held_out=pa.nulls(1, pa.bool_()), n_tokens=pa.nulls(1, pa.int64()), chunk=pa.array([pid << 32 | chunk], pa.int64()), words=words, ids=tokens, lengths=many, learned=which, before=pa.array([before], pa.int32()))

        for b in (whole.slice(at, PIECE) for whole in batches for at in range(0, whole.num_rows, PIECE)):
            doc_type = b.column(0).type
            first, held, tokens = n, [], []
            for name, text in zip(b.column(1).to_pylist(), utf8(b.column(2)), strict=True):
                out = zlib.crc32((name or "").encode()) % remainders == 0
                held.append(out)
                lengths.append(0)
                learned.append(not out)
                text, at, count, last, done = text.translate(LOWER), 0, 0, b"", False
                while not done:
                    cut = _BLANK.search(text, at + SLICE)
                    end = cut.start() if cut else len(text)
                    found = text[at:end].split()
                    at, done = end, end >= len(text)
                    if done:
                        found.append(b"")
                    ids.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                    lengths[-1] += len(found)
                    size, count, last = size + len(found), count + len(found), found[-1] if found else last
                    if size >= AT_ONCE:
                        yield written()
                        known, ids, lengths, learned = _Ids({b"": 0}), [], [] if done else [0], [] if done else [not out]
                        start, chunk, before, size = n + done, chunk + 1, 0 if done else known[last], 0
                tokens.append(count)
                n += 1
            rows = n - first
            none, no_int, no_long = pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64())
            yield batch(pid=pa.array([pid] * rows, pa.int32()), n=pa.array(range(first, n), pa.int32()), doc_id=b.column(0), held_out=pa.array(held, pa.bool_()), n_tokens=pa.array(tokens, pa.int64()), chunk=no_long, words=none, ids=none, lengths=none, learned=none, before=no_int)
        if size:
            yield written()

    return own.mapInArrow(run, f"pid int, n int, doc_id {kind}, held_out boolean, n_tokens long, chunk long, words binary, ids binary, lengths binary, learned binary, before int")


class Chunk:
    """A chunk with its words in the order of their parts: keys, words, the words' parts' edges; tokens: w, a word's place among them."""

    def __init__(self, row: dict, parts: int) -> None:
        words = pa.array(listed(row["words"]), pa.binary())
        self.lengths, self.learned = np.frombuffer(row["lengths"], np.int32).astype(np.int64), np.frombuffer(row["learned"], np.uint8)
        self.some = self.lengths > 0
        self.starts = (np.cumsum(self.lengths) - self.lengths)[self.some]
        keys = hashes(words)
        part = (keys % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.words, self.keys, self.edges = words.take(pa.array(order)), keys[order], np.searchsorted(part[order], np.arange(parts + 1))
        self.w, self.end, self.before = rank[opened(row["ids"], np.int32)], rank[0], rank[row["before"]]

    def each(self) -> Iterator[tuple[int, slice]]:
        """The parts that have words of the chunk, and which."""
        for q in np.flatnonzero(np.diff(self.edges)).tolist():
            yield q, slice(int(self.edges[q]), int(self.edges[q + 1]))

    def pairs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Part for part of first words: the pairs of words at the part's tokens (first * number of words + second), and these tokens'
        places. A part at a time, since arrays of all tokens take most of a worker's memory."""
        at = np.empty(len(self.w), np.int64)
        at[1:] = self.w[:-1]
        at[self.starts] = self.end
        at[:1] = self.before
        at <<= 32
        at |= np.arange(len(at), dtype=np.int32)
        at.sort()
        edges = np.searchsorted(at, self.edges << 32)
        for q in np.flatnonzero(np.diff(edges)).tolist():
            own = at[edges[q] : edges[q + 1]]
            place = own & 0xFFFFFFFF
            yield q, (own >> 32) * len(self.keys) + self.w[place], place

    def by_document(self, values: np.ndarray) -> np.ndarray:
        """Sums of the tokens' values for each document."""
        out = np.zeros(len(self.lengths), values.dtype)
        if len(self.starts):
            out[self.some] = np.add.reduceat(values, self.starts)
        return out


def sent_words(tokens: DataFrame, parts: int) -> DataFrame:
    """(part, chunk, words, n): words of a chunk, and how often they are in its training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("n", pa.binary())])
        for b in batches:
            for row in b.to_pylist():
                own = Chunk(row, parts)
                n, words = np.bincount(own.w[np.repeat(own.learned, own.lengths) > 0], minlength=len(own.keys)).astype(np.int32), own.words.to_pylist()
                yield from rows_of(schema, [{"part": q, "chunk": row["chunk"], "words": b"\n".join(words[at]), "n": squeezed(n[at])} for q, at in own.each()]).to_batches()

    return tokens.mapInArrow(run, "part int, chunk long, words binary, n binary")


_WORDS = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("codes", pa.binary()), ("words", pa.binary()), ("keys", pa.binary()), ("c", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])


def merged_words(table: pa.Table) -> pa.Table:
    """One row for the words of a part, by key, and one for each chunk: where its words are among them (codes)."""
    part, rows = table.column("part")[0].as_py(), table.to_pylist()
    own = [listed(r["words"]) for r in rows]
    words = pa.array([w for ws in own for w in ws], pa.binary())
    keys, first, at = np.unique(hashes(words), return_index=True, return_inverse=True)
    c = np.bincount(at, np.concatenate([opened(r["n"], np.int32) for r in rows]), len(keys)).astype(np.int64)
    ends = np.cumsum([len(ws) for ws in own])
    out = [{"part": part, "chunk": r["chunk"], "codes": squeezed(x.astype(np.int32))} for r, x in zip(rows, np.split(at, ends[:-1]), strict=True)]
    out.append({"part": part, "words": b"\n".join(words.take(pa.array(first)).to_pylist()), "keys": keys.tobytes(), "c": c.tobytes(), "n": int(c.sum()), "v": int((c > 0).sum())})
    return rows_of(_WORDS, out)


def sent_pairs(tokens: DataFrame, parts: int) -> DataFrame:
    """(part, chunk, u, many, ws, w, n): keys of first words, how many second words each has, the keys of all second words, each
    once, which of them every pair has, times in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), *[(x, pa.binary()) for x in ("u", "many", "ws", "w", "n")]])
        for b in batches:
            for row in b.to_pylist():
                own = Chunk(row, parts)
                learned = np.repeat(own.learned, own.lengths)
                here, rank = np.zeros(len(own.keys), bool), np.zeros(len(own.keys), np.int32)
                for q, code, place in own.pairs():
                    code <<= 1
                    code |= learned[place]
                    code.sort()
                    first = np.flatnonzero(np.r_[True, code[1:] >> 1 != code[:-1] >> 1])
                    n = np.add.reduceat((code & 1).astype(np.int32), first).astype(np.uint32)
                    u, w = np.divmod(code[first] >> 1, len(own.keys))
                    us, many = np.unique(u, return_counts=True)
                    here[w] = True
                    ws = np.flatnonzero(here)
                    here[ws], rank[ws] = False, np.arange(len(ws))
                    yield from rows_of(schema, [{"part": q, "chunk": row["chunk"], "u": own.keys[us].tobytes(), "many": squeezed(many.astype(np.int32)), "ws": own.keys[ws].tobytes(), "w": squeezed(rank[w]), "n": squeezed(n)}]).to_batches()

    return tokens.mapInArrow(run, "part int, chunk long, u binary, many binary, ws binary, w binary, n binary")


_PAIRS = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("to", pa.int32()), *[(x, pa.binary()) for x in ("codes", "us", "u_once", "mu", "mw", "c", "keys", "once", "more")], ("ones", pa.int64()), ("twos", pa.int64())])


def merged_pairs(table: pa.Table, parts: int) -> pa.Table:
    """Rows of three kinds. One for the pairs of a part: first words (us), how many second words each has once (u_once), and its
    pairs that occur more often: first word (mu), second word among those asked for (mw), count c. For each chunk codes: 0 a pair
    not in training, 1 one that occurs once, k + 2 the k-th of the others. For each part of second words (to): their keys, and
    how many pairs with them occur once, or more often, which are asked for."""
    part, rows = table.column("part")[0].as_py(), table.to_pylist()
    u = np.concatenate([np.repeat(np.frombuffer(r["u"], np.uint64), opened(r["many"], np.int32)) for r in rows])
    w = np.concatenate([np.frombuffer(r["ws"], np.uint64)[opened(r["w"], np.int32)] for r in rows])
    counts = [opened(r["n"], np.uint32) for r in rows]
    n, ends = np.concatenate(counts), np.cumsum([len(x) for x in counts])
    with np.errstate(over="ignore"):
        pair = u * GOLD + w
    order = np.argsort(pair)
    pair = pair[order]
    begins = np.r_[True, pair[1:] != pair[:-1]]
    first = np.flatnonzero(begins)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(begins) - 1
    c = np.add.reduceat(n[order].astype(np.int64), first)
    seen = np.flatnonzero(c)
    us, ui = np.unique(u[order[first[seen]]], return_inverse=True)
    ws, wi = np.unique(w[order[first[seen]]], return_inverse=True)
    once, more = c[seen] == 1, np.flatnonzero(c[seen] > 1)
    more = more[np.argsort(ui[more], kind="stable")]
    code = np.zeros(len(c), np.int32)
    code[seen[once]] = 1
    code[seen[more]] = 2 + np.arange(len(more))
    n_once, n_more = np.bincount(wi[once], minlength=len(ws)), np.bincount(wi[more], minlength=len(ws))
    to = (ws % np.uint64(parts)).astype(np.int64)
    by_part = np.argsort(to, kind="stable")
    asked = np.empty(len(ws), np.int64)
    asked[by_part] = np.cumsum(n_more[by_part] > 0) - 1
    out = [{"part": part, "chunk": r["chunk"], "codes": squeezed(x)} for r, x in zip(rows, np.split(code[group], ends[:-1]), strict=True)]
    out.append({"part": part, "us": us.tobytes(), "u_once": np.bincount(ui[once], minlength=len(us)).astype(np.int64).tobytes(), "mu": ui[more].astype(np.int32).tobytes(), "mw": asked[wi[more]].astype(np.int32).tobytes(), "c": c[seen[more]].tobytes(), "ones": int(once.sum()), "twos": int((c == 2).sum())})
    edges = np.searchsorted(to[by_part], np.arange(parts + 1))
    for q in np.flatnonzero(np.diff(edges)).tolist():
        mine = by_part[edges[q] : edges[q + 1]]
        out.append({"part": part, "to": q, "keys": ws[mine].tobytes(), "once": squeezed(n_once[mine].astype(np.int64)), "more": squeezed(n_more[mine].astype(np.int64))})
    return rows_of(_PAIRS, out)


_BYTES = pa.list_(pa.binary())
_STATE = pa.schema([("part", pa.int32()), *[(x, pa.binary()) for x in ("words", "keys", "c", "once", "c1", "t")], ("p", _BYTES), ("ask_from", pa.list_(pa.int32())), ("ask", _BYTES), ("customers", pa.int64()), ("tables", pa.int64()), ("ones", pa.int64()), ("twos", pa.int64()), ("known", pa.float64())])
_STATE_SQL = "part int, words binary, keys binary, c binary, once binary, c1 binary, t binary, p array<binary>, ask_from array<int>, ask array<binary>, customers long, tables long, ones long, twos long, known double"


def first_state(words: pa.Table, asks: pa.Table) -> pa.Table:
    """The restaurant of all words, its part: every pair has one table. ask: which words a part of pairs asks for."""
    row = words.to_pylist()[0]
    keys = np.frombuffer(row["keys"], np.uint64)
    once, c1, ask_from, ask = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), [], []
    for r in asks.to_pylist():
        at = np.searchsorted(keys, np.frombuffer(r["keys"], np.uint64))
        more = opened(r["more"], np.int64)
        once[at] += opened(r["once"], np.int64)
        c1[at] += more
        if more.any():
            ask_from.append(r["part"])
            ask.append(at[more > 0].astype(np.int32).tobytes())
    return counted({**{x: row[x] for x in ("part", "words", "keys", "c")}, "once": once.tobytes(), "p": [], "ask_from": ask_from, "ask": ask}, once + c1, np.minimum(1, once + c1))


def counted(row: dict, c1: np.ndarray, t: np.ndarray) -> pa.Table:
    return rows_of(_STATE, [{**row, "c1": c1.tobytes(), "t": t.tobytes(), "customers": int(c1.sum()), "tables": int(t.sum()), "ones": int((c1 == 1).sum()), "twos": int((c1 == 2).sum())}])


def spelling_customers(state: DataFrame) -> DataFrame:
    """(key, c): what the words' tables send to the restaurants of the longest contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys, starts = spelled(pa.array(listed(words), pa.binary()))
                found, place = np.unique(keys, return_inverse=True)
                c = np.bincount(place, np.repeat(np.frombuffer(t, np.int64), np.diff(np.append(starts, len(keys))))).astype(np.int64)
                yield batch(key=pa.array(found[c > 0]), c=pa.array(c[c > 0]))

    return state.select("words", "t").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def seat_bytes(customers: DataFrame, model: Spelling, first: bool, seed: int, scratch: Scratch) -> Spelling:
    """One sweep of the restaurants of bytes, from the longest contexts to the empty one."""
    new, discounts = Spelling(strength=model.strength), list(model.discounts)
    sent = customers.sparkSession.sparkContext.broadcast(model)
    for depth in range(DEPTH, -1, -1):
        customers = scratch.written(customers)
        if first:
            r = customers.agg(F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two")).first()
            discounts[depth] = discount(r.one, r.two)
        d = discounts[depth]

        def run(batches: Iterator[pa.RecordBatch], depth=depth, d=d) -> Iterator[pa.RecordBatch]:
            old = sent.value
            parents, open_tables = old.predicted(depth - 1), old.open_tables(depth)
            by_key = np.argsort(old.keys[depth])
            for b in batches:
                key, c = b.column(0).to_numpy(), b.column(1).to_numpy()
                where, symbol = np.divmod(key, SYMBOLS)
                own = np.zeros(len(key), np.int64)
                if len(by_key):
                    at = by_key[np.minimum(np.searchsorted(old.keys[depth], key, sorter=by_key), len(by_key) - 1)]
                    own = np.where(old.keys[depth][at] == key, old.tables[depth][at], 0)
                t = table_counts(key, c, old.strength + d * (open_tables[where] - own), parents[where % max(1, len(parents)), symbol], d, seed + depth)
                yield batch(key=b.column(0), c=b.column(1), t=pa.array(t))

        found = scratch.written(customers.mapInArrow(run, "key long, c long, t long"))
        scratch.drop(customers)
        table = found.toArrow()  # 32^depth contexts of 257 symbols at most
        new.keys[depth], new.customers[depth], new.tables[depth] = (table.column(x).to_numpy() for x in ("key", "c", "t"))
        up = F.pmod(F.expr(f"key div {SYMBOLS}"), F.lit(CLASS ** max(0, depth - 1))) * SYMBOLS + F.col("key") % SYMBOLS
        customers = found.groupBy(up.alias("key")).agg(F.sum("t").alias("c"))
    new.discounts = tuple(discounts)
    return new


@dataclass
class Sample:
    """What a sweep leaves for predictions: the byte model, the words' tables, and the spelling probability of all training words."""

    model: Spelling
    tables: int
    known: float


def predictive_logs(c: np.ndarray, t_mean: np.ndarray, words: pa.Array, samples: list[Sample], d: float, strength: float, total: int) -> np.ndarray:
    """Natural logs of the words' predictive probabilities in the restaurant of all words, averaged over samples.

    All words without customers are one event, as in the base score: its probability is that of any spelling but theirs.
    """
    new = [np.log((strength + d * s.tables) / len(samples)) + np.where(c > 0, spelling_logs(s.model, words), np.log(max(1e-300, 1 - s.known))) for s in samples]
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.logaddexp.reduce(new), np.log(c - d * t_mean)) - np.log(strength + total)


def priced_words(state: DataFrame, model: Spelling, tables: int, customers: int, d: float, strength: float, keep: bool) -> DataFrame:
    """state with the words' probabilities in their restaurant as the last of p (or, unless keep, the only one); known: the
    probability of the spellings of all words of training."""
    sent = state.sparkSession.sparkContext.broadcast(Sample(model, tables, 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                words, c1, t = pa.array(listed(row["words"]), pa.binary()), np.frombuffer(row["c1"], np.int64), np.frombuffer(row["t"], np.int64)
                p = np.exp(predictive_logs(c1, t, words, [sent.value], d, strength, customers))
                known = float(np.exp(spelling_logs(sent.value.model, words))[c1 > 0].sum())
                yield from rows_of(_STATE, [{**row, "p": [*(row["p"] if keep else []), p.tobytes()], "known": known}]).to_batches()

    return state.mapInArrow(run, _STATE_SQL)


def answers(state: DataFrame) -> DataFrame:
    """(part, sender, p): the probabilities of the words that a part of pairs asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("sender", pa.int32()), ("p", pa.binary())])
        for b in batches:
            for row in b.to_pylist():
                p = np.frombuffer(row["p"][-1], np.float64)
                yield from rows_of(schema, [{"part": q, "sender": row["part"], "p": p[np.frombuffer(at, np.int32)].tobytes()} for q, at in zip(row["ask_from"], row["ask"], strict=True)]).to_batches()

    return state.select("part", "p", "ask_from", "ask").mapInArrow(run, "part int, sender int, p binary")


_SEATED = pa.schema([("part", pa.int32()), ("to", pa.int32()), ("sums", pa.binary()), ("t", pa.binary()), ("t_sum", pa.binary()), ("u_tables", _BYTES)])
_SEATED_SQL = "part int, to int, sums binary, t binary, t_sum binary, u_tables array<binary>"


def seat_pairs(pairs: DataFrame, seated: DataFrame | None, state: DataFrame, d: float, strength: float, seed: int, sampled: int) -> DataFrame:
    """One sweep of all words' restaurants: tables t of the pairs that occur more than once, t_sum over samples, all tables of
    each restaurant (u_tables, by sample), and for each part of second words (to) their new customers (sums)."""
    columns = pairs.where("us is not null").select("part", "u_once", "mu", "mw", "c")
    old = ["t", "t_sum", "u_tables"]
    if seated is None:
        both = columns.withColumns({x: F.lit(None).cast(_SEATED_SQL.split(f" {x} ")[1].split(",")[0]) for x in old})
    else:
        both = columns.join(seated.where("to is null").select("part", *old), "part")

    def run(key: tuple, own: pa.Table, sent: pa.Table) -> pa.Table:
        row, got = own.to_pylist()[0], sorted(sent.to_pylist(), key=lambda r: r["sender"])
        u_once, c = np.frombuffer(row["u_once"], np.int64), np.frombuffer(row["c"], np.int64)
        mu, mw = np.frombuffer(row["mu"], np.int32), np.frombuffer(row["mw"], np.int32)
        t = np.frombuffer(row["t"], np.int32).astype(np.int64) if row["t"] is not None else np.ones(len(c), np.int64)
        tables = u_once + np.bincount(mu, t, len(u_once)).astype(np.int64)
        p = np.concatenate([np.zeros(0), *[np.frombuffer(r["p"], np.float64) for r in got]])
        t = table_counts(np.arange(len(c)) + (row["part"] << 32), c, strength + d * (tables[mu] - t), p[mw], d, seed)
        u_tables = (u_once + np.bincount(mu, t, len(u_once)).astype(np.int64)).tobytes()
        t_sum = t + (np.frombuffer(row["t_sum"], np.int32) if sampled > 0 else 0) if sampled >= 0 else t
        out = [{"part": row["part"], "t": t.astype(np.int32).tobytes(), "t_sum": t_sum.astype(np.int32).tobytes(), "u_tables": [*(row["u_tables"] if sampled > 0 else []), u_tables]}]
        sums = np.split(np.bincount(mw, t, len(p)).astype(np.int64), np.cumsum([len(r["p"]) // 8 for r in got])[:-1]) if got else []
        out += [{"part": row["part"], "to": r["sender"], "sums": x.tobytes()} for r, x in zip(got, sums, strict=True)]
        return rows_of(_SEATED, out)

    return both.groupBy("part").cogroup(answers(state).groupBy("part")).applyInArrow(run, _SEATED_SQL)


def seat_words(state: DataFrame, seated: DataFrame, model: Spelling, d: float, strength: float, tables: int, seed: int) -> DataFrame:
    """One sweep of the restaurant of all words, whose customers are the tables of seat_pairs(): state with new c1 and t."""
    sent = state.sparkSession.sparkContext.broadcast(model)

    def run(key: tuple, own: pa.Table, got: pa.Table) -> pa.Table:
        row, new = own.to_pylist()[0], {r["part"]: r["sums"] for r in got.to_pylist()}
        c1, t = np.frombuffer(row["once"], np.int64).copy(), np.frombuffer(row["t"], np.int64)
        for sender, at in zip(row["ask_from"], row["ask"], strict=True):
            c1[np.frombuffer(at, np.int32)] += np.frombuffer(new[sender], np.int64)
        share = np.exp(spelling_logs(sent.value, pa.array(listed(row["words"]), pa.binary())))
        t = table_counts(np.frombuffer(row["keys"], np.int64), c1, strength + d * (tables - t), share, d, seed)
        return counted(row, c1, t)

    sums = seated.where("to is not null").select(F.col("to"), "part", "sums")
    return state.groupBy("part").cogroup(sums.groupBy("to")).applyInArrow(run, _STATE_SQL)


def prices(codes: DataFrame, state: DataFrame, pairs: DataFrame, seated: DataFrame, unseen: list[float], d: float, strength: float) -> DataFrame:
    """(chunk, part, c, t, p, v). Of a chunk's words of a part: counts c, and for each sample the tables t of a word's restaurant
    and the probability p in the restaurant of all words. Of a chunk's pairs of a part: v, the customers less discounts."""
    samples = len(unseen)
    left = codes.unionByName(state.select("part", "keys", F.col("c").alias("wc"), "p"), allowMissingColumns=True)
    right = pairs.where("chunk is not null").select("part", "chunk", "codes").unionByName(pairs.where("us is not null").select("part", "us", "c"), allowMissingColumns=True)
    right = right.unionByName(seated.where("to is null").select("part", "t_sum", "u_tables"), allowMissingColumns=True)
    schema = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("c", pa.binary()), ("t", pa.binary()), ("p", pa.binary()), ("v", pa.binary())])

    def run(key: tuple, of_words: pa.Table, of_pairs: pa.Table) -> pa.Table:
        part, own, beside = key[0].as_py(), of_words.to_pylist(), of_pairs.to_pylist()
        row = next(r for r in own if r["keys"] is not None)
        c, keys = np.frombuffer(row["wc"], np.int64), np.frombuffer(row["keys"], np.uint64)
        us, values, tables = np.zeros(0, np.uint64), np.array([0.0, 1 - d]), [np.zeros(0, np.int64)] * samples
        of_part, found = (next((r for r in beside if r[x] is not None), None) for x in ("us", "t_sum"))
        if of_part is not None:
            us, tables = np.frombuffer(of_part["us"], np.uint64), [np.frombuffer(x, np.int64) for x in found["u_tables"]]
            values = np.r_[values, np.frombuffer(of_part["c"], np.int64) - d * np.frombuffer(found["t_sum"], np.int32) / samples]
        total = np.zeros((samples, len(keys)), np.int64)
        total[:, np.searchsorted(keys, us)] = tables
        p = np.array([np.where(c > 0, np.frombuffer(p, np.float64), x) for p, x in zip(row["p"], unseen, strict=True)], np.float32)
        values = values.astype(np.float32)
        out = []
        for r in own:
            if r["chunk"] is not None:
                own_codes = opened(r["codes"], np.int32)
                out.append({"chunk": r["chunk"], "part": part, "c": squeezed(c[own_codes]), "t": squeezed(total[:, own_codes]), "p": squeezed(p[:, own_codes])})
        out += [{"chunk": r["chunk"], "part": part, "v": squeezed(values[opened(r["codes"], np.int32)])} for r in beside if r["chunk"] is not None]
        return rows_of(schema, out)

    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(run, "chunk long, part int, c binary, t binary, p binary, v binary")


def sums(tokens: DataFrame, priced: DataFrame, parts: int, floor: float, samples: int, d: float, strength: float) -> DataFrame:
    """(key, n_known, base_score, score) of the documents of each chunk."""
    schema = pa.schema([("key", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(key: tuple, own: pa.Table, got: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        got = {x: {q.as_py(): y.as_buffer() for q, y in zip(got.column("part"), got.column(x), strict=True) if y.is_valid} for x in ("c", "t", "p", "v")}
        c, left, p = (np.concatenate([opened(y, kind).reshape(n, -1) for _, y in sorted(got[x].items())], axis=1) for x, kind, n in (("c", np.int64, 1), ("t", np.int64, samples), ("p", np.float32, samples)))
        c = c[0]
        left = ((strength + d * left) / (strength + c)).astype(np.float32)
        chunk = Chunk(row, parts)
        score = np.empty(len(chunk.w))
        for q, code, place in chunk.pairs():
            code, at = np.unique(code, return_inverse=True)
            u, w = np.divmod(code, len(c))
            price = opened(got["v"][q], np.float32) / (strength + c[u])
            for k in range(samples):
                price += left[k][u].astype(np.float64) * p[k][w] / samples
            score[place] = np.log10(price)[at]
        score = chunk.by_document(score)
        known, base = (chunk.by_document(x[chunk.w]) for x in ((c > 0).astype(np.int64), np.log10((c + 0.1) / floor)))
        keys = np.arange(len(score)) + ((row["pid"] << 32) + row["n"])
        return pa.Table.from_arrays([pa.array(keys), pa.array(known), pa.array(base), pa.array(score)], schema=schema)

    return tokens.groupBy("chunk").cogroup(priced.groupBy("chunk")).applyInArrow(run, "key long, n_known long, base_score double, score double")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", burn: int = 1, samples: int = 3, strength: float = 1.0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of docs: log10 probabilities."""
    with brief_shuffles(docs.sparkSession):
        return _scored(docs, id_col, text_col, burn, samples, strength)


def _scored(docs: DataFrame, id_col: str, text_col: str, burn: int, samples: int, strength: float) -> DataFrame:
    scratch = Scratch()

    def drop(*tables: DataFrame | None) -> None:
        for table in tables:
            scratch.drop(table)

    rows = scratch.written(chunks(docs, id_col, text_col))
    tokens = rows.where("chunk is not null").select("chunk", "pid", "n", "words", "ids", "lengths", "learned", "before")
    parts = 1 + int(rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first().n) // PART

    words = scratch.written(sent_words(tokens, parts).groupBy("part").applyInArrow(merged_words, "part int, chunk long, codes binary, words binary, keys binary, c binary, n long, v long"))
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()

    def merged(table: pa.Table) -> pa.Table:
        return merged_pairs(table, parts)

    pairs = scratch.written(sent_pairs(tokens, parts).groupBy("part").applyInArrow(merged, "part int, chunk long, to int, codes binary, us binary, u_once binary, mu binary, mw binary, c binary, keys binary, once binary, more binary, ones long, twos long"))
    r = pairs.agg(F.sum("ones").alias("ones"), F.sum("twos").alias("twos")).first()
    d_pairs = discount(r.ones, r.twos)

    def first(key: tuple, own: pa.Table, asks: pa.Table) -> pa.Table:
        return first_state(own, asks)

    asks = pairs.where("to is not null").select("to", "part", "keys", "once", "more")
    start = scratch.written(words.where("keys is not null").select("part", "words", "keys", "c").groupBy("part").cogroup(asks.groupBy("to")).applyInArrow(first, _STATE_SQL))

    def all_of(state: DataFrame) -> tuple:
        return tuple(x or 0 for x in state.agg(*[F.sum(x).alias(x) for x in ("customers", "tables", "ones", "twos", "known")]).first())

    customers, tables, ones, twos, _ = all_of(start)
    d_words, model, seated, unseen = discount(ones, twos), Spelling(), None, []
    state = scratch.written(priced_words(start, model, tables, customers, d_words, strength, False))
    drop(start)
    codes, pairs_asked = scratch.written(words.where("chunk is not null").select("part", "chunk", "codes")), pairs
    pairs = scratch.written(pairs.where("to is null").drop("to", "keys", "once", "more"))
    drop(words, pairs_asked)
    for i in range(burn + samples):
        before, seated = seated, scratch.written(seat_pairs(pairs, seated, state, d_pairs, strength, 10 * i + 5, i - burn))
        new = scratch.written(seat_words(state, seated, model, d_words, strength, tables, 10 * i))
        drop(before, state)
        customers, tables, *_ = all_of(new)
        model = seat_bytes(spelling_customers(new), model, i == 0, 10 * i + 1, scratch)
        state = scratch.written(priced_words(new, model, tables, customers, d_words, strength, i > burn))
        drop(new)
        if i >= burn:
            unseen.append((strength + d_words * tables) * max(1e-300, 1 - all_of(state)[4]) / (strength + customers))

    floor = totals.n + 0.1 * (totals.v + 1)
    priced = scratch.written(prices(codes, state, pairs, seated, unseen, d_pairs, strength))
    drop(codes, state, pairs, seated)
    by_doc = sums(tokens, priced, parts, floor, samples, d_pairs, strength).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")])
    every = rows.where("chunk is null").withColumn("key", F.shiftleft(F.col("pid").cast("long"), 32).bitwiseOR(F.col("n").cast("long")))
    out = every.join(by_doc, "key", "left").select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", F.coalesce("n_known", F.lit(0)).alias("n_known"), F.lit(totals.n).cast("long").alias("train_tokens"), F.coalesce("base_score", F.lit(0.0)).alias("base_score"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return scratch.last(out)
