"""BPE encoding and decoding with forced boundaries.

A merge can only join two symbols that stand side by side inside some vocabulary token. Where a word has a pair that
no token contains, every encoding has a cut, so the word falls into fragments that are encoded one by one and
concatenated; fragments repeat far more than words do, and their ids are kept in a bounded cache per Python worker.

Null texts count as empty and give no ids and an empty decoded text. Texts of any length are encoded whole: a long
unbroken word takes a heap instead of the short scan. Rows are independent, so repeated rows, empty tables and further
columns need no care; the work is one map over the documents without a shuffle.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import batch, map_batches

_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"
#: The letters, digits and white space of Latin-1 after lower-casing.
_LATIN = re.compile(_PARTS.format(L="a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", N="0-9\xb2\xb3\xb9\xbc-\xbe", S="\\x09-\\x0d \x85\xa0"))
_ANY = regex.compile(_PARTS.format(L=r"\p{L}", N=r"\p{N}", S=r"\p{White_Space}"))


_SEPARATORS = re.compile("[\\x1c-\\x1f]")
#: Above every rank.
_NONE = 1 << 40


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Kept(dict):
    """make(text), kept for the texts seen last: two generations of at most `most` entries, so the size is bounded."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, text: str) -> bytes:
        if (value := self.older.get(text)) is None:
            value = self.make(text)
        if len(text) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[text] = value
        return value


class Bpe:
    """A byte-level BPE vocabulary with word ends, from the JSON text of a tokenizer file."""

    def __init__(self, text: str, cached: int = 150_000) -> None:
        spec = json.loads(text)
        vocab, self.end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t.encode() for t, i in (vocab | self.special).items()}
        # by first * 65536 + second: the rank of each merge, and by rank the id that it makes; 65536 ids at most
        self.made = [vocab[a + b] for a, b in merges]
        self.rank = {vocab[a] << 16 | vocab[b]: rank for rank, (a, b) in reversed([*enumerate(merges)])}
        letters = _byte_letters()
        self.inner, self.last = [vocab[x] for x in letters], [vocab[x + self.end] for x in letters]
        # base symbols side by side inside some token, whether or not they merge first; others force a cut
        self.joined = {pair: self.rank.get(pair, _NONE) for t in vocab for pair in self._pairs(t, vocab)}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks, self.words = _Kept(self._chunk, cached), _Kept(self._word, cached)
        self.pieces: dict[tuple, list[int]] = {}
        self.cached = cached

    def _pairs(self, token: str, vocab: dict[str, int]) -> list[int]:
        ended = token.endswith(self.end) and token != self.end
        body = token.removesuffix(self.end) if ended else token
        symbols = [vocab[x] for x in (body[:-1] if ended else body)] + ([vocab[body[-1] + self.end]] if ended else [])
        return [x << 16 | y for x, y in zip(symbols, symbols[1:], strict=False)]

    def word_ids(self, word: bytes) -> list[int]:
        """Ids of one word: its forced cuts, then each fragment on its own."""
        symbols = [*map(self.inner.__getitem__, word)]
        symbols[-1] = self.last[word[-1]]
        ranks = [*map(self.joined.get, [x << 16 | y for x, y in zip(symbols, symbols[1:], strict=False)])]
        if None not in ranks:
            return self._merged(symbols, ranks)
        out: list[int] = []
        start = 0
        for i in [i for i, r in enumerate(ranks) if r is None] + [len(ranks)]:
            out += self._fragment(symbols[start : i + 1], ranks[start:i])
            start = i + 1
        return out

    def _fragment(self, symbols: list[int], ranks: list[int]) -> list[int]:
        if len(symbols) == 1:
            return symbols
        if len(symbols) > 32:
            return self._merged(symbols, ranks)
        if (known := self.pieces.get(key := tuple(symbols))) is None:
            if len(self.pieces) >= self.cached:
                self.pieces.clear()
            known = self.pieces[key] = self._merged(symbols, ranks)
        return known

    def _merged(self, ids: list[int], ranks: list[int]) -> list[int]:
        """The lowest rank first, the leftmost of equals; ranks: of each symbol with the next."""
        if len(ids) > 48:
            return self._heap(ids)
        get, made = self.rank.get, self.made
        while ranks and (best := min(ranks)) < _NONE:
            i = ranks.index(best)
            ids[i] = new = made[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << 16 | ids[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 16 | new, _NONE)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.rank.get
        left, right = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 16 | ids[i + 1], _NONE)) < _NONE]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := get(ids[i] << 16 | ids[j], _NONE)) < _NONE:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = self.made[rank], -1, right[j]
            if right[j] < n:
                left[right[j]] = i
            push(left[i], i)
            push(i, right[i])
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        return np.array(self.word_ids(word.encode()), dtype="<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a text without special tokens: composed, lower-cased, cut into words; white space only separates."""
        if not chunk.isascii() and not unicodedata.is_normalized("NFC", chunk):
            chunk = unicodedata.normalize("NFC", chunk)
        chunk = chunk.replace("Σ", "σ").lower()  # a capital sigma is small in every position
        try:
            chunk.encode("latin-1")
            found = _LATIN.findall(chunk)
        except UnicodeEncodeError:
            found = _ANY.findall(chunk)
        return b"".join(map(self.words.__getitem__, found))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian 32-bit integers."""
        out: list[bytes] = []
        for part in self.split.split(text) if self.split and "<" in text else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
            elif _SEPARATORS.search(part):  # str.split() cuts at these, the vocabulary's pattern does not
                out.append(self._chunk(part))
            else:
                out.extend(map(self.chunks.__getitem__, part.split()))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The tokens of the ids with a space between two, in UTF-8; special tokens are kept."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def _model(text: str) -> Bpe:
    return Bpe(text)


def _file(df: DataFrame, path: str):
    """The vocabulary file (a few MB whatever the data), read by the driver and broadcast."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids) per document: ids are little-endian 32-bit integers in one binary value.

    path: the tokenizer's file, on the driver. decoded: also gives the decoded text, from the ids, in the same pass.
    """
    spec = _file(docs, path)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        model = _model(spec.value)
        ids = [model.encode(t or "") for t in b.column(1).to_pylist()]
        out = {"id": b.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
        return batch(**out, **({"decoded": pa.array([model.decode(x) for x in ids], pa.binary()).cast(pa.string())} if decoded else {}))

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), f"id {kind}, n_tokens long, ids binary" + ", decoded string" * decoded, run)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) of a table of ids as encode() gives them; null ids give an empty text."""
    spec = _file(encoded, path)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        model = _model(spec.value)
        return batch(id=b.column(0), text=pa.array([model.decode(x or b"") for x in b.column(1).to_pylist()], pa.binary()).cast(pa.string()))

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_batches(encoded.select(id_col, ids_col), f"id {kind}, text string", run).withColumnRenamed("id", id_col)
