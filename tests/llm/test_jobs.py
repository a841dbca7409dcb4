"""The operators as Spark jobs on small tables with odd rows: nulls, empty and long texts, ties, clashing columns."""

from __future__ import annotations

import gzip
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, embeddings, html_text, licences, pii, quality, simhash, urlrules, warc
from quarry.llm.components import components
from quarry.llm.queries import RULES, tokenizer
from quarry.llm.shared import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, fp string"
LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \n", "one two three four", "one two three four", "One  two three four", LONG, "call +1 (499) 555-6503 or a@b.org", "a b c d e f g h i j k l"]
    rows = [(i, t, None, "s", None, "x", "y") for i, t in enumerate(texts)] + [(3, texts[3], None, "s", None, "x", "y"), (None, "null id one two", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_components(fp: list[int], ids: list) -> list:
    root = list(range(len(fp)))
    for _ in fp:
        for i in range(len(fp)):
            for j in range(len(fp)):
                if (fp[i] ^ fp[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    return [min((ids[j] for j in range(len(fp)) if root[j] == root[i] and ids[j] is not None), default=None) for i in range(len(fp))]


def test_simhash(spark, docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    want = brute_components([int(r.fingerprint, 16) for r in rows], [r.doc_id for r in rows])
    assert [r.component_id for r in rows] == want
    assert {r.fingerprint for r in rows if r.doc_id in (0, 1, 2)} == {"0" * 16}
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_blocks_of_a_hot_bucket(spark):
    """Chunks of a bucket that is over the block size give the same components as one block."""
    r = np.random.default_rng(1)
    base = int(r.integers(0, 1 << 62))
    fp = sorted({base ^ sum(1 << int(b) for b in r.choice(64, k, replace=False)) for k in (1, 2, 3, 4, 5, 6) for _ in range(60)})
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fp], "fp long")
    one, many = ({(r.node, r.root) for r in simhash.linked(table, Scratch(), block=b).collect()} for b in (4096, 32))
    assert one == many and one


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(130)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (1000, 1020)]
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root[x] for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bpe(docs, empty):
    rows = bpe.encode(docs, tokenizer(), decoded=True).collect()
    assert len(rows) == docs.count() and all(len(r.ids) == 4 * r.n_tokens for r in rows)
    assert [(r.n_tokens, r.decoded) for r in rows if r.doc_id == 0] == [(0, "")]
    back = bpe.decode(bpe.encode(docs, tokenizer()), tokenizer()).collect()
    assert sorted(x.text for x in back) == sorted(x.decoded for x in rows)
    assert bpe.encode(empty, tokenizer()).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, "B, c d e f g h i j K"), (2, None), (3, "one two"), (None, "three four")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert rows[8].n_hit == 10 and rows[8].items == ["1"] and rows[8].contaminated and rows[0].n_words == 0
    assert rows[4].items == ["", "3"] and rows[4].n_hit == 4
    assert decontaminate.without_contaminated(docs, items).where("doc_id in (3, 4, 5, 8)").count() == 0
    assert len(decontaminate.shards(items, "item_id", "text", 10, 250)) > 4
    sharded = decontaminate.contamination(docs, items, most_bytes=250)
    assert {r.doc_id: r for r in sharded.collect()} == rows and sharded.count() == docs.count()
    kept = [decontaminate.without_contaminated(docs, items, most_bytes=b).select("doc_id", "text").collect() for b in (250, 1 << 20)]
    assert sorted(map(str, kept[0])) == sorted(map(str, kept[1]))
    assert decontaminate.contamination(empty, items).count() == 0 and decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_licences_and_pii(docs, empty):
    assert licences.licences(docs).count() == docs.count() and licences.licences(empty).count() == 0
    rows = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert (rows[7].n_email, rows[7].n_phone, rows[7].n_ip, rows[7].n_card) == (1, 1, 0, 0)
    assert rows[7].base_sha256 == hashlib.sha256(b"email:26:33,phone:5:22").hexdigest() and rows[0].spans == ""
    clean = {r.doc_id: r for r in pii.without_personal_data(docs).collect()}
    assert clean[7].text == "call <phone> or <email>" and clean[7].n_chars == 23 and clean[0].text is None
    assert pii.personal_data(empty).count() == 0


def test_quality(spark, docs, empty):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, " ".join(word() if not bad or r.random() < 0.8 else r.choice(["awful", "stupid"]) for _ in range(40))))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 0), (99999, None, None)], "doc_id long, quality int, toxic int")
    kept = {x.doc_id for x in quality.kept(table, marks).collect()}
    good = {i for i in range(600) if i % 5}
    assert len(kept & good) > 0.99 * len(good) and len(kept - good) <= 2
    assert {x.doc_id for x in quality.filtered(table.withColumn("_score", F.lit("clash")), marks).collect()} == kept
    assert quality.filtered(empty, marks).columns == empty.columns and quality.filtered(empty, marks).count() == 0
    assert quality.kept(docs, marks.limit(0)).count() == docs.count() and quality.kept(empty, marks).count() == 0


def test_kth_largest(spark):
    values = [random.Random(9).randint(-(10**17), 10**17) for _ in range(3000)] + [5] * 50 + [9 * 10**18, -9 * 10**18]
    keys = spark.createDataFrame([(v,) for v in values], "key long")
    for k in (1, 2, 1500, 3049, 3052):
        assert quality.kth_largest(keys, k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(keys, 0) is None and quality.kth_largest(keys.limit(0), 1) is None


def test_importance_ratios_against_brute_force(spark):
    """Counts and log ratios of all n-grams of a small corpus, word by word."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["ab", "cd,", "ef", "gh!!", "IJ"] if i % 3 else ["ab", "zz", "zz", "cd,"]) for _ in range(60))) for i in range(90)]
    target = frozenset(i for i, _ in rows if i % 3 and i % 2)
    table = spark.createDataFrame([*rows, (None, "ab cd"), (1000, None)], "doc_id long, text string")
    counted = quality.counts(table, target)
    got = {x.gram: (x.raw, x.own) for x in counted.collect()}
    want, known = {}, quality._Hashes()
    for i, text in [*rows, (None, "ab cd")]:
        words, pairs = quality.grams(text.encode(), known)
        for key in set(map(int, [*words, *pairs])):
            a, b = want.get(key, (0, 0))
            want[key] = a + 1, b + (i in target)
    assert got == want
    model = quality.fit(counted, sure=(2.0, 2.0))
    for pair in (False, True):
        part = {k: v for k, v in want.items() if (k >= 1 << quality.WORD_BITS) == pair}
        raw, own = (sum(v[i] for v in part.values()) for i in (0, 1))
        for gram, (n, mine) in part.items():
            expected = n * own / raw
            weight = math.log((mine + 0.1) / (expected + 0.1)) / (1 + math.exp(min(50, (4 - (mine - expected) ** 2 / (expected + 1)) / 2)))
            assert model.weights[gram] == pytest.approx(weight)
    assert np.count_nonzero(model.weights) <= len(want)
    words, pairs = quality.grams(b"zz zz cd, ef", known)
    assert model.score(words, pairs) < 0 < model.score(*quality.grams(b"ef gh!! IJ", known))
    plain = sum(model.weights[g] for g in [*words, *pairs])
    assert model.score(words, pairs) == pytest.approx(plain * math.sqrt(400 / len(words))) and model.score(words[:0], pairs[:0]) == 0


def test_quality_on_labelled_documents(spark):
    """On given tables with the query's own settings: the draw moves rows, target documents stay and most others go."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    table, score, _ = quality._resampled(docs, docs, labels, "doc_id", "text", ["doc_id"])
    kept = {r.doc_id for r in table.collect()}
    model = quality.fit(quality.counts(docs, frozenset(k for k, good in quality.labelled(labels).items() if good and not quality._held_out(k))))
    best = {r.doc_id for r in quality.scores(docs, model).orderBy(F.desc("_score"), "doc_id").limit(len(kept)).collect()}
    assert len(kept - best) >= 0.005 * len(kept)
    rows = labels.join(docs, "doc_id").collect()
    stay = lambda good: [r.doc_id in kept for r in rows if (r.quality == 1 and r.toxic == 0) == good]
    assert np.mean(stay(True)) >= 0.97 and np.mean(stay(False)) <= 0.4


def test_the_draw_follows_the_weights(spark):
    """Of one drawn row per seed, each is chosen about as often as its importance weight says."""
    scores, trials = [0.0, 1.0, 2.0, -1.0], 3000
    rows = spark.createDataFrame([(t, i, s) for t in range(trials) for i, s in enumerate(scores)], "t long, i int, s double")
    keys = rows.withColumn("key", quality.noisy(F.col("s"), F.col("t"), F.col("i")))
    chosen = [0] * 4
    for r in keys.groupBy("t").agg(F.max_by("i", "key").alias("i")).collect():
        chosen[r.i] += 1
    total = sum(map(math.exp, scores))
    for n, s in zip(chosen, scores, strict=True):
        p = math.exp(s) / total
        assert abs(n / trials - p) < 4 * math.sqrt(p * (1 - p) / trials)
    drawn = quality.drawn(keys, 500)
    assert drawn.count() == 500 and drawn.agg(F.min("key")).first()[0] >= keys.join(drawn, ["t", "i"], "left_anti").agg(F.max("key")).first()[0]


def test_url_rules(spark):
    urls = ["http://a.org/x", "http://ORG/", "http://Example.org/es/1", "https://www.example.org/en/12?x", "http://example.org/en/2", "http://x.com/de/", "http://x.com/fr/#t", "http://x.com", "nothing", None, "http://xorg/", "://org/", "http://u@a.org:80/", "http://" + "a." * 3000 + "org/", "http://x.com/de/"]
    pages = spark.createDataFrame([*enumerate(urls), (None, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    for r in urlrules.verdicts(pages, rules).collect():
        url = "http://a.org/" if r.page_id is None else urls[r.page_id]
        rest = (url or "").partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"), url
    assert urlrules.verdicts(pages, rules.limit(0)).where("verdict <> 'allow'").count() == 0
    assert urlrules.verdicts(pages.limit(0), rules).count() == 0


def test_warc(spark, tmp_path):
    html = [None, "", "<p>é</p>", "<p>é</p>", "x" * 300_000, "<p>é</p>", "<p>é</p>"]
    pages = spark.createDataFrame([(i if i < 6 else None, None if i == 1 else f"http://h/{i}\n", h, "clash") for i, h in enumerate(html)] + [(11, "http://h", "rep", "x"), (11, "http://h", "rep", "x")], "page_id long, url string, html string, file string")
    rows = warc.read_records(warc.archive(pages.repartition(3), folder=f"file://{tmp_path}", roll=100)).collect()
    got = {int(r.key): r for r in rows if r.key and r.key != "11"}
    assert len(rows) == 9 and [got[i].refers_to for i in range(6)] == ["1", None, "5", "5", None, None]
    assert [got[i].record_type for i in range(6)] == ["revisit", "response", "revisit", "revisit", "response", "response"]
    assert all(r.record_type == "response" and r.refers_to is None for r in rows if r.key in (None, "11"))
    assert got[4].payload_bytes == 300_000 and bytes(got[4].payload) == b"x" * 300_000 and got[4].url == "http://h/4%0A"
    assert all(r.payload_digest == warc.digest((h or "").encode()) and r.payload_bytes == len((h or "").encode()) for r, h in ((got[i], html[i]) for i in range(6)))
    assert got[2].payload is None and bytes(got[5].payload) == "<p>é</p>".encode()
    assert list(tmp_path.glob("members/*.idx")) and not list(tmp_path.glob("monolithic/*"))
    lone = warc.read_records(warc.archive(pages, folder=f"file://{tmp_path}/least", least=10)).where("record_type = 'revisit'")
    assert lone.count() == 0
    assert warc.read_records(warc.archive(pages.limit(0), folder=f"file://{tmp_path}/none")).count() == 0


def test_warc_archives_of_others(spark, tmp_path):
    """Files without a list of records, and a task for each; a file that is cut off or ends in rubbish is an error."""
    whole = gzip.compress(b"".join(warc.record(str(i), "http://h", b"p" * i * 50, "2024-01-01T00:00:00Z") for i in range(40)))
    for k in range(3):
        (tmp_path / f"{k}.warc.gz").write_bytes(whole)
    files = spark.createDataFrame([(f"file://{tmp_path}/{k}.warc.gz",) for k in range(3)], "file string")
    index = warc.normalise(files, f"file://{tmp_path}/members")
    assert index.count() == 120 and index.select("file").distinct().count() == 3
    assert warc.read_records(index).agg(F.sum("payload_bytes")).first()[0] == 3 * 50 * sum(range(40))
    for bad in (whole[:-200], whole + b"rubbish", gzip.compress(gzip.decompress(whole)[:-300])):
        (tmp_path / "0.warc.gz").write_bytes(bad)
        with pytest.raises(Exception, match="ValueError"):
            warc.normalise(files, f"file://{tmp_path}/bad").count()


def test_html(spark):
    pages = spark.createDataFrame([(1, None, None), (1, "u", "<p>a<p>b"), (None, "u", "")], "page_id long, url string, html string")
    assert sorted((r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [("", 0), ("", 0), ("a\nb", 3)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 16))
    vectors = [*base, *(base[:20] + 0.05 * r.normal(size=(20, 16))), *base[:5], *(base[0] + 0.03 * r.normal(size=(40, 16)))]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 16), (902, [math.nan] * 16), (903, [1.0, None]), (904, [2.0, 0.0]), (905, [4.0, 0.1]), (None, [1.0] * 16), (907, [])]
    got = {x.vec_id: x for x in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=16).collect()}
    assert len(got) == len(rows)
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    root = list(range(len(x)))
    for _ in range(5):
        for i in range(len(x)):
            root[i] = min(root[j] for j in np.flatnonzero(near[i]))
    assert [got[i].n_links for i in range(len(x))] == (near.sum(axis=1) - 1).tolist()
    assert [got[i].component_id for i in range(len(x))] == root
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 907)) and got[905].component_id == 904 and not got[905].kept


@pytest.mark.parametrize("dims", [64, 768])
def test_embedding_links_found_at_the_limit(spark, dims):
    """Of pairs with a cosine from 0.95 to 0.96 at least 98 of 100 are found, and no pair below."""
    r = np.random.default_rng(dims)
    a = r.normal(size=(400, dims))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = r.normal(size=a.shape)
    side -= (side * a).sum(axis=1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosines = np.where(np.arange(400) < 350, r.uniform(0.9501, 0.96, 400), r.uniform(0.93, 0.9499, 400))
    b = cosines[:, None] * a + np.sqrt(1 - cosines**2)[:, None] * side
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*a, *b])]
    got = {x.vec_id: x.n_links for x in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[i] for i in range(350)) >= 0.98 * 350 and all(got[i] == got[i + 400] for i in range(350))
    assert all(got[i] == 0 for i in [*range(350, 400), *range(750, 800)])


def test_pipeline_stages_on_odd_rows(spark, docs, empty):
    """Null, empty and very long texts, repeated rows and ids, null ids, clashing names and empty tables."""
    import corpus_pipeline

    folder, rows = "/root/testdata/sf0.001", docs.count()
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert name == "bpe" or out.schema == docs.schema
        assert stage(spark, empty, folder).count() == 0
    assert stages["quality"](spark, docs, folder).count() == rows  # nothing here is like what the labels reject
    kept = stages["near_duplicates"](spark, docs, folder).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    # texts without words are one group, those of 3, 4 and 5 are another; rows without an id stay
    assert sorted(ids) == [0, 3, 6, 7, 8] and len(kept) - len(ids) == 2
    assert stages["decontamination"](spark, docs, folder).count() == rows
    clean = {r.doc_id: r.text for r in stages["personal_data"](spark, docs, folder).collect()}
    assert clean[7] == "call <phone> or <email>" and clean[0] is None and len(clean[6]) == len(LONG)
    tokens = stages["bpe"](spark, docs, folder).collect()
    assert len(tokens) == rows and {r.n_tokens for r in tokens if r.doc_id in (0, 1)} == {0}


def test_near_duplicate_stage_beyond_what_is_sent(spark, docs, monkeypatch):
    """The same rows stay where too many ids go for them to be sent to all tasks; of rows of one id always the same one."""
    import corpus_pipeline

    more = docs.union(spark.createDataFrame([(8, "another text under the same id", None, "s", None, "x", "y")], docs.schema))
    few = sorted(map(str, corpus_pipeline.drop_near_duplicates(spark, more, "").collect()))
    monkeypatch.setattr(corpus_pipeline, "MOST_SENT", 0)
    assert sorted(map(str, corpus_pipeline.drop_near_duplicates(spark, more.repartition(5), "").collect())) == few


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = corpus_pipeline.run(spark, folder)
    assert len(corpus_pipeline.STAGES) == 5 and 0 < rows.count() <= docs.count()
    first = corpus_pipeline.keep_quality(spark, docs, folder)
    assert first.columns == docs.columns and first.schema == docs.schema
    second = corpus_pipeline.drop_near_duplicates(spark, first, folder)
    assert second.columns == docs.columns and second.select("doc_id").distinct().count() == second.count()
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(first, width=5, similarity=0.8).collect()}
    assert {r.doc_id for r in second.collect()} == {i for i, c in found.items() if i == c}


def test_a_hot_url_is_split(spark):
    """Two thirds of the rows have one URL and many have none: the join to verdicts is split, and columns may clash."""
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    url = F.when(F.col("id") % 3 > 0, "https://hot.example.org/es/page").when(F.col("id") % 2 == 0, F.concat(F.lit("http://h"), F.col("id").cast("string"), F.lit(".com/de/x")))
    pages = spark.range(60_000).repartition(6).select(F.col("id").alias("page_id"), url.alias("url"), F.lit("x").alias("host"), F.lit("y").alias("action"), F.lit("z").alias("rule"))
    how = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in how}
    try:
        for k, v in how.items():
            spark.conf.set(k, v)
        out = urlrules.verdicts(pages, rules)
        rows = out.collect()
        assert "isSkew=true" in out._jdf.queryExecution().executedPlan().toString() or "SortMergeJoin(skew=true)" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    want = {"hot.example.org": ("example.org/es/", "block"), "": (None, "allow")}
    assert len(rows) == 60_000 and all((r.rule, r.verdict) == want.get(r.host, ("com/de/", "block")) for r in rows)
