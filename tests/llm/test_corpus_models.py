"""Merkle manifest, collocations and language-model scores against brute force, on odd rows too."""

from __future__ import annotations

import hashlib
import math
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import count
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import collocations, manifest, pitman_yor

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOW = str.maketrans(_UPPER, _UPPER.lower())
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows: list[tuple]) -> Counter:
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for r in rows:
        own = sha(*map(enc, r))
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        changed = sha(*map(enc, (*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4])))
        groups[r[1]].append(((r[0] is not None, r[0] or 0), own, changed, r[0]))

    def levels(nodes: list[str]) -> list[list[str]]:
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def beside(found: list[list[str]], at: int) -> list[tuple[list[str], list[str]]]:
        out = []
        for nodes in found[:-1]:
            run = at // 3 * 3
            out.append((nodes[run:at], nodes[at + 1 : run + 3]))
            at //= 3
        return out

    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([n for _, n, _, _ in sorted(groups[g])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = Counter()
    for i, g in enumerate(names):
        for k, (_, own, changed, key) in enumerate(sorted(groups[g])):
            path, node = beside(trees[g], k) + beside(top, i), changed
            for a, b in path:
                node = sha(*a, node, *b)
            out[(key, own, trees[g][-1][0], top[-1][0], sha(*[x for a, b in path for x in (*a, *b)]), node, node == top[-1][0])] += 1
    return out


ODD = [
    (1, "a", "en", 3, "x\ny"), (2, "a", None, None, None), (None, "a", "en", 1, "n"), (None, "a", "en", 1, "n"), (None, None, None, None, None), (7, "b", "en", 0, ""), (-5, "a", "en", 2, "m\n"), (1 << 62, "a", "fr", 1, "\n\n"),
    (-(1 << 63), "a", "fr", 1, "z"), ((1 << 63) - 1, "a", "fr", 1, "z"), (63, "a", "de", 4, "é\n"), (64, "a", "de", 4, "q"), (2, "a", "en", 5, "again"), (2, "a", "en", 5, "again"), (3, "é", "en", 5, "x"), (3, "z", "en", 5, "x"), (9, "", "en", 5, "x"),
]


@pytest.mark.parametrize("rows", [ODD, [(5, "s", "en", 1, "one\n")], [(3 * i * i, f"s{i % 2}", "en", i, f"line {i}\nmore") for i in range(900)]])
def test_manifest_equals_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as g", "'y' as word", "0 as pos", "1 as leaf").repartition(3)
    got = Counter(tuple(r) for r in manifest.manifest(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    assert got == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    assert manifest.manifest(spark.createDataFrame([], DOCS)).count() == 0


def brute_collocations(rows: list[tuple], least: int, most: int) -> list[tuple]:
    f, n, langs = defaultdict(Counter), Counter(), set()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(_LOW)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
        langs.add(lang)
    out = []
    for lang in langs:
        found = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, k = min((2_000_000 * a // (f[lang][p[:k]] + f[lang][p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), f[lang][p[:k]], f[lang][p[k:]]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(rows_)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("least,most", [(2, 5), (3, 1000), (30, 10)])
def test_collocations_equal_brute_force(spark, least, most):
    rng = np.random.default_rng(5)
    words, ends = ["the", "of", "Of", "la", "Été", "a-b", "x\x1cy", "q", "w9", "(c)"], [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "?"]
    rows = [(str(rng.choice(["en", "fr"])), "".join(f"{words[min(9, int(rng.exponential(2)))]}{ends[int(rng.integers(10))]}" for _ in range(int(rng.integers(0, 60))))) for _ in range(60)]
    rows += [(None, "one two three four. one two three four"), ("und", "one two three"), ("en", None), ("en", ""), ("en", " . "), (None, None)] + [("en", "the very same line of words")] * 40
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "f long, lang string, text string").selectExpr("*", "'x' as prefix", "'y' as word", "1 as shard").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least, most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute_collocations(rows, least, most)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_scores_of_counts_beyond_64_bits(spark):
    """The query's own arithmetic, at counts whose products pass 64 bits."""
    a, l, r = 9_000_000_000_000_000_000, 9_100_000_000_000_000_000, 9_200_000_000_000_000_000
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").selectExpr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as s").first()
    assert row.s == 2_000_000 * a // (l + r)


def test_slices_cut_between_pieces_only(monkeypatch):
    text = b"One two, three\nfour five. six " * 40
    whole = [collocations.slices(text)]
    monkeypatch.setattr(collocations, "SLICE", 7)
    parts = [*collocations.slices(text)]
    assert len(parts) > 20 and b"".join(parts) == b"".join(whole[0]) and all(p.startswith(b".") for p in parts[1:])


def test_filter_keeps_all_and_few_others():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    own = collocations.Bloom(16)
    for word, bit in own.places(h[:2000]):
        np.bitwise_or.at(own.words, word, bit)
    assert own.has(h[:2000]).all() and own.has(h[2000:]).mean() < 0.05


def stirling(c: int, d: float) -> list[float]:
    row = [1.0]
    for n in range(1, c):
        row = [(row[t - 1] if t else 0.0) + ((n - d * (t + 1)) * row[t] if t < n else 0.0) for t in range(n + 1)]
    return row


@pytest.mark.parametrize("c,outside,share,d", [(5, 3.0, 0.2, 0.6), (12, 40.0, 0.05, 0.8), (90, 10.0, 0.1, 0.5)])
def test_seating_follows_the_posterior(c, outside, share, d):
    """Tables of one dish: t of c customers has the weight S_d(c, t) (outside | d)_t share^t."""
    weights = [s * math.prod((outside + d * i) * share for i in range(t)) for t, s in enumerate(stirling(c, d), 1)]
    want = np.array(weights) / sum(weights)
    rng = np.random.default_rng(3)
    draw = iter(lambda: float(rng.random()), None)
    sizes, seen = [], Counter()
    for i in range(6000):
        sizes = pitman_yor.reseated(sizes, c, outside, share, d, draw)
        assert sum(sizes) == c and min(sizes) > 0
        seen[len(sizes)] += i >= 500
    got = np.array([seen[t] / 5500 for t in range(1, c + 1)])
    assert abs(got - want).sum() < 0.12


def test_customers_come_and_go():
    draw = iter(np.random.default_rng(0).random(20_000).tolist())
    sizes = []
    for c in (1, 3, 70, 60, 2, 5000, 4990, 1):
        sizes = pitman_yor.reseated(sizes, c, 2.0, 0.3, 0.7, draw)
        assert sum(sizes) == c and min(sizes) > 0


def test_restaurants_of_bytes_share_parents_and_add_up_to_one():
    model, rng = pitman_yor.Spelling(), np.random.default_rng(2)
    for depth in range(pitman_yor.DEPTH + 1):
        n = pitman_yor.CLASS**depth * pitman_yor.SYMBOLS
        model.keys[depth] = np.unique(rng.integers(0, n, 500))
        model.customers[depth] = rng.integers(1, 9, len(model.keys[depth]))
        model.tables[depth] = np.minimum(model.customers[depth], 2)
    p = model.predicted(pitman_yor.DEPTH)
    assert np.allclose(p.sum(axis=1), 1) and (p > 0).all()
    empty = np.setdiff1d(np.arange(len(p)), model.keys[3] // pitman_yor.SYMBOLS)[0]
    assert np.allclose(p[empty], model.predicted(2)[empty % pitman_yor.CLASS**2])


def test_all_events_add_up_to_one():
    words, c, t = pa.array(["the", "of", "", "thé", "new"]), np.array([5, 2, 3, 1, 0]), np.array([2, 1, 1, 1, 0])
    model = pitman_yor.Spelling()
    share = np.exp(pitman_yor.spelling_logs(model, words))
    sample = pitman_yor.Sample(model, int(t.sum()), float(share[c > 0].sum()))
    assert np.exp(pitman_yor.predictive_logs(c, t, words, [sample], 0.6, 1.0, int(c.sum()))).sum() == pytest.approx(1.0)


def test_spelling_keys():
    keys, starts = pitman_yor.spelled(pa.array(["ab", "", "c"]))
    s, e = pitman_yor.SYMBOLS, pitman_yor.END
    assert starts.tolist() == [0, 3, 4]
    assert keys.tolist() == [ord("a"), 1 * s + ord("b"), (1 * 32 + 2) * s + e, e, ord("c"), 3 * s + e]


def test_same_draws_wherever_they_are_made():
    keys = np.array([5, -7, 1 << 60])
    n = np.array([3, 0, 2])
    u = pitman_yor.uniform(keys, n, 4)
    assert len(u) == 5 and (pitman_yor.uniform(keys[2:], n[2:], 4) == u[3:]).all() and not np.allclose(pitman_yor.uniform(keys, n, 5), u)


def test_scores_on_odd_rows(spark):
    rows = [(i, "The cat and the dog " * (i % 5) + f"word{i}") for i in range(60)] + [(100, None), (101, ""), (102, " \t\n"), (None, "the null one"), (7, "twice"), (7, "twice"), (103, "ÉTÉ the\x00x " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n", "2 as pid").repartition(3)
    got = pitman_yor.scored(docs).collect()
    tokens = [(k, re.findall("[^\x20\x09-\x0d]+", (t or "").translate(_LOW)) + [""], zlib.crc32(str(k if k is not None else "").encode()) % 10 == 0) for k, t in rows]
    c = Counter(w for _, ws, out in tokens if not out for w in ws)
    total, kinds = sum(c.values()), len(c)
    want = Counter((k, out, len(ws), sum(c[w] > 0 for w in ws), total, round(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws), 6)) for k, ws, out in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    same = [r.score for r in got if r.doc_id == 7 and r.n_tokens == 2]
    assert same[0] == pytest.approx(same[1])


def test_scores_without_documents_or_training(spark):
    assert pitman_yor.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = next(i for i in count() if zlib.crc32(str(i).encode()) % 10 == 0)
    row = pitman_yor.scored(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(row.score)


def test_held_out_text_is_likelier_than_by_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = [r for r in pitman_yor.scored(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)


def test_packed_postings_come_back_whole():
    rng = np.random.default_rng(4)
    for high, most in ((50, 3), (300_000, 900), (5, 100_000)):
        rows, docs = np.unique(np.stack([np.sort(rng.integers(0, 40, 300)), rng.integers(0, high, 300)]), axis=1)
        times = rng.integers(1, most, len(rows))
        steps, counts = pitman_yor.packed(rows, docs + 1000, times, 41, 1000)
        lengths, found, n = pitman_yor.unpacked(steps, counts, np.full(41, 1000))
        got = Counter()
        for r, d, t in zip(np.repeat(np.arange(41), lengths).tolist(), found.tolist(), n.tolist(), strict=True):
            got[r, d] += t
        assert +got == Counter({(r, d): t for r, d, t in zip(rows.tolist(), (docs + 1000).tolist(), times.tolist(), strict=True)})
    steps, counts = pitman_yor.packed(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0)
    assert len(steps) == len(counts) == 0 and len(pitman_yor.unpacked(steps, counts, np.zeros(0, np.int64))[1]) == 0


@pytest.mark.parametrize("c,outside,share,d", [(12, 40.0, 0.05, 0.8), (90, 10.0, 0.1, 0.5), (1300, 400.0, 0.01, 0.9), (1300, 4000.0, 0.3, 0.6)])
def test_all_customers_are_seated_anew(c, outside, share, d):
    """Numbers of tables drawn at once follow the posterior; beyond EXACT customers too, by their means."""
    logs = np.full(c + 1, -np.inf)
    logs[1], t = 0.0, np.arange(1, c + 1)
    for n in range(2, c + 1):
        logs[1 : n + 1] = np.logaddexp(logs[:n], logs[1 : n + 1] + np.log(np.maximum(1e-300, n - 1 - d * t[:n])))
    logs = logs[1:] + np.cumsum(np.log((outside + d * np.arange(c)) * share))
    want = np.exp(logs - logs.max())
    want /= want.sum()
    n = 20_000
    got = pitman_yor.table_counts(np.arange(n) * 7919, np.full(n, c), np.full(n, outside), np.full(n, share), d, 3)
    sd = math.sqrt((want * t**2).sum() - (want * t).sum() ** 2)
    assert got.min() >= 1 and got.max() <= c and abs(got.mean() - (want * t).sum()) < 0.06 * sd and abs(got.std() - sd) < 0.06 * sd


def test_words_are_seated_in_the_restaurant_of_the_word_before(spark):
    """Texts of the same words in another order score otherwise: those in a known order are likelier."""
    rows = [(i, "one two three four five six") for i in range(40)] + [(1000 + i, "six four two five three one") for i in range(2)]
    got = {r.doc_id: r for r in pitman_yor.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000].base_score == pytest.approx(got[0].base_score) and got[0].score > got[1000].score + 1


def test_words_keep_their_places_in_chunks(spark, monkeypatch):
    """Small parts give the same counts as one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    columns = ("doc_id", "n_tokens", "n_known", "base_score")
    whole = {r.doc_id: r for r in pitman_yor.scored(docs, burn=0, samples=1).collect()}
    monkeypatch.setattr(pitman_yor, "PART", 3000)
    for r in pitman_yor.scored(docs, burn=0, samples=1).collect():
        assert [r[x] for x in columns[:3]] == [whole[r.doc_id][x] for x in columns[:3]]
        assert r.base_score == pytest.approx(whole[r.doc_id].base_score) and r.score == pytest.approx(whole[r.doc_id].score, rel=0.1)


def test_arrays_come_back_from_few_bytes():
    rng = np.random.default_rng(5)
    for values in (np.zeros(0, np.int64), np.array([-1, 0, 1 << 62]), rng.geometric(0.3, 5000).astype(np.int32), rng.integers(0, 1 << 63, 99).astype(np.uint64), rng.random((3, 40)).astype(np.float32)):
        assert (pitman_yor.opened(pitman_yor.squeezed(values), values.dtype) == values.ravel()).all()
        back = pitman_yor.opened(pitman_yor.squeezed(values.T), values.dtype)
        assert back.flags.writeable and (back == values.T.ravel()).all()
    assert len(pitman_yor.squeezed(rng.geometric(0.3, 5000))) < 5000


def test_scores_leave_no_shuffle_behind(spark, monkeypatch):
    """Once a table is written, no file of its shuffle is on disk any more; the session's setting comes back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(name), []
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    written = pitman_yor.Scratch.written

    def files() -> set:
        return {f for folder in folders for f in Path(folder).glob("*/shuffle_*.data")}

    def watched(self, df):
        old = files()
        out = written(self, df)
        until = time.monotonic() + 2
        while files() - old and time.monotonic() < until:  # files are deleted in the background
            time.sleep(0.05)
        seen.append(len(files() - old))
        return out

    monkeypatch.setattr(pitman_yor.Scratch, "written", watched)
    docs = spark.createDataFrame([(i, f"one two three word{i % 7}") for i in range(50)], "doc_id long, text string")
    assert pitman_yor.scored(docs, burn=0, samples=1).count() == 50
    assert len(seen) > 5 and not any(seen)
    assert spark.conf.get(name) == before


def test_pairs_of_words_travel_in_few_bytes(spark):
    """Keys of second words go once for each chunk and part: 12 bytes for each pair of words before, and no pair is lost."""
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.3, 3000), 2000))) for i in range(20)], "doc_id long, text string").repartition(1)
    tokens = pitman_yor.chunks(docs, "doc_id", "text").where("chunk is not null").select("chunk", "pid", "n", "words", "ids", "lengths", "learned", "before")
    rows = [r.asDict() for r in pitman_yor.sent_pairs(tokens, 3).collect()]
    pairs = {p for _, text in docs.collect() for p in zip(["", *text.split()], [*text.split(), ""], strict=True)}
    assert sum(len(x) for r in rows for x in r.values() if isinstance(x, bytearray | bytes)) < 7 * len(pairs)
    assert sum(len(pitman_yor.opened(r["n"], np.uint32)) for r in rows) == len(pairs)


class Steps:
    """In place of a DataFrame: gives the function that Spark would call."""

    def groupBy(self, *columns):
        return self

    cogroup = groupBy

    def mapInArrow(self, run, schema):
        return run

    applyInArrow = mapInArrow


def chunk_row(ids: np.ndarray, n_words: int, lengths: list[int], learned: list[int], before: int = 0) -> dict:
    words = b"\n".join([b"", *(b"w%d" % i for i in range(1, n_words))])
    return {"chunk": 7, "pid": 0, "n": 0, "words": words, "ids": pitman_yor.squeezed(ids.astype(np.int32)), "lengths": np.array(lengths, np.int32).tobytes(), "learned": np.array(learned, np.uint8).tobytes(), "before": before}


def priced_rows(rows: list[dict], row: dict, parts: int, samples: int) -> pa.Table:
    """What prices() sends to a chunk, made up from the words' and pairs' keys alone."""
    chunk, out = pitman_yor.Chunk(row, parts), []
    for q, at in chunk.each():
        key = chunk.keys[at].astype(np.int64) & 1023
        out.append({"chunk": 7, "part": q, "c": pitman_yor.squeezed(key % 5), "t": pitman_yor.squeezed(np.array([key % (k + 2) for k in range(samples)])), "p": pitman_yor.squeezed(np.array([(key + k + 1) / 2048 for k in range(samples)], np.float32))})
    for r in rows:
        first = np.repeat(np.frombuffer(r["u"], np.uint64), pitman_yor.opened(r["many"], np.int32)).astype(np.int64) & 15
        second = np.frombuffer(r["ws"], np.uint64)[pitman_yor.opened(r["w"], np.int32)].astype(np.int64) & 15
        out.append({"chunk": 7, "part": r["part"], "v": pitman_yor.squeezed((0.25 * first + 0.5 * second).astype(np.float32))})
    return pa.Table.from_pylist(out, pa.schema([("chunk", pa.int64()), ("part", pa.int32()), *[(x, pa.binary()) for x in ("c", "t", "p", "v")]]))


def test_chunks_send_all_pairs_and_sum_their_prices():
    """A chunk that begins within a text, with texts that have no token in it: pairs, times and sums as by brute force."""
    rng, parts = np.random.default_rng(8), 5
    lengths, learned = [40, 0, 1, 300, 0, 60], [1, 0, 1, 0, 1, 1]
    ids = rng.integers(0, 30, sum(lengths))
    row = chunk_row(ids, 30, lengths, learned, before=9)
    rows = [r for b in pitman_yor.sent_pairs(Steps(), parts)([pa.RecordBatch.from_pylist([row])]) for r in b.to_pylist()]
    key = pitman_yor.hashes(pa.array([b"", *(b"w%d" % i for i in range(1, 30))], pa.binary())).tolist()
    want, triples, at = Counter(), [], 0
    for doc, n in enumerate(lengths):
        for i in range(at, at + n):
            u = ids[i - 1] if i > at else 9 if i == 0 else 0
            want[key[u], key[ids[i]]] += learned[doc]
            triples.append((doc, key[u], key[ids[i]]))
        at += n
    got = Counter()
    for r in rows:
        u = np.repeat(np.frombuffer(r["u"], np.uint64), pitman_yor.opened(r["many"], np.int32)).tolist()
        w = np.frombuffer(r["ws"], np.uint64)[pitman_yor.opened(r["w"], np.int32)].tolist()
        for a, b, n in zip(u, w, pitman_yor.opened(r["n"], np.uint32).tolist(), strict=True):
            assert a % parts == r["part"] and (a, b) not in got
            got[a, b] = n
    assert got == want
    out = pitman_yor.sums(Steps(), Steps(), parts, 1000.0, 2, 0.7, 1.0)((7,), pa.Table.from_pylist([row]), priced_rows(rows, row, parts, 2)).to_pylist()
    known, base, score = np.zeros(6, int), np.zeros(6), np.zeros(6)
    for doc, u, w in triples:
        c, cu, low = (w & 1023) % 5, (u & 1023) % 5, u & 1023
        known[doc] += c > 0
        base[doc] += math.log10((c + 0.1) / 1000)
        score[doc] += math.log10((0.25 * (u & 15) + 0.5 * (w & 15) + sum((1 + 0.7 * (low % (k + 2))) * ((w & 1023) + k + 1) / 2048 for k in range(2)) / 2) / (1 + cu))
    assert [r["key"] for r in out] == list(range(6)) and [r["n_known"] for r in out] == known.tolist()
    assert np.allclose([r["base_score"] for r in out], base) and np.allclose([r["score"] for r in out], score, rtol=1e-5)


def test_memory_of_a_chunk_is_bounded():
    """Peak bytes for each token of a chunk; arrays of all its tokens, many at once, took 45 for pairs and 75 for sums."""
    rng, n, parts = np.random.default_rng(9), 1 << 20, 16
    row = chunk_row(rng.integers(0, 5000, n), 5000, [1024] * (n // 1024), [1] * (n // 1024))
    own, rows, peaks = pa.Table.from_pylist([row]), [], []
    tracemalloc.start()
    try:
        for b in pitman_yor.sent_pairs(Steps(), parts)(own.to_batches()):
            rows.append(b)
        peaks.append(tracemalloc.get_traced_memory()[1] / n)
        got = priced_rows([r for b in rows for r in b.to_pylist()], row, parts, 3)
        rows.clear()
        before = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        pitman_yor.sums(Steps(), Steps(), parts, 1000.0, 3, 0.7, 1.0)((7,), own, got)
        peaks.append((tracemalloc.get_traced_memory()[1] - before) / n)
    finally:
        tracemalloc.stop()
    assert peaks[0] < 30 and peaks[1] < 40, peaks
