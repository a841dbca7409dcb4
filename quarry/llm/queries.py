"""The registered queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, collocations, decontaminate, embeddings, html_text, licences, manifest, pii, pitman_yor, quality, simhash, urlrules, warc
from quarry.llm.shared import written
from quarry.sources.shared import shared_folder

#: Host, path prefix and action of each rule.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = _read(spark, sf_dir, "pages"), shared_folder(spark)
    kind = pages.schema["page_id"].dataType
    rows = written(warc.read_records(warc.archive(pages, folder=folder), payloads=False))
    warc.drop(spark, folder)
    return rows.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return urlrules.verdicts(_read(spark, sf_dir, "pages"), rules)


def op4_quality_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.kept(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).withColumn("kept", F.lit(True))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(_read(spark, sf_dir, "documents"), tokenizer(), decoded=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licences.licences(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_read(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scored(_read(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_html_text, op2_warc, op3_url_rules, op4_quality_sample, op5_bpe, op6_simhash, op7_licences, op8_embeddings, op9_pii, op10_decontaminate, op11_pitman_yor, op12_manifest, op13_collocations, pipeline)
    return {f.__name__: f for f in own}


_OP2 = """
with d as (select page_id, encode(coalesce(html, '')) as body from pages),
     h as (select page_id, octet_length(body) as payload_bytes, sha1(body) as hex from d),
     b as (select page_id, payload_bytes, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + cast(list_sum(list_transform(range(0, 5), lambda k: case when substr(cast(unhex(hex) as bit)::varchar, cast(5 * i + k + 1 as int), 1) = '1' then 1 << cast(4 - k as int) else 0 end)) as int), 1)), lambda x, y: x || y) as payload_digest from h),
     m as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as last from b)
select payload_digest, cast(payload_bytes as bigint) as payload_bytes, page_id,
       case when page_id < last then 'revisit' else 'response' end as record_type,
       case when page_id < last then last end as refers_to
from m
"""

_OP3 = """
with r(r_host, r_path, action) as (values """ + ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES) + """),
     s as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
     t as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from s)
select page_id, host, path,
       (select r_host || r_path from r where (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path) order by length(r_host || r_path) desc limit 1) as rule,
       coalesce((select action from r where (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path) order by length(r_host || r_path) desc limit 1), 'allow') as verdict
from t
"""

_OP8 = """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings where embedding is not null),
     l as (select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
     c as (select vec_id as x, vec_id as y from embeddings union select c.x, l.y from c join l on c.y = l.x)
select vec_id, (select count(*) from l where l.x = vec_id) as n_links, m as component_id, vec_id = m as kept
from (select x as vec_id, min(y) as m from c group by x)
"""

_OP10 = """
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
     bw as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
     bp as (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from bw where len(w) > 0),
     bg as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g from bp),
     sizes as (select distinct n from bg),
     dp as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n),
     hit as (select doc_id, i, dp.n, item_id from dp join bg on bg.n = dp.n and bg.g = array_to_string(w[i:i + dp.n - 1], ' ')),
     words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
     items as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id)), ',') as ids from hit group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words using (doc_id) left join items using (doc_id)
"""



def _enc(column: str) -> str:
    return f"coalesce(octet_length(encode(cast({column} as varchar))) || ':' || {column}, '-')"


#: CRC-32, eight steps for each character of the decimal id; only its lowest bit is used.
_EVEN_CRC = """list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
        lambda a, b: list_reduce(list_prepend(xor(a, b), cast([0, 0, 0, 0, 0, 0, 0, 0] as bigint[])), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) & 1 = 1"""
_FIELDS = " || ".join(map(_enc, ("doc_id", "source", "lang", "n_chars")))


def _up(name: str, start: str) -> str:
    """Nodes of all levels, three at a time, from start (g, pos, digest, n)."""
    return f"""{name} as (select g, 0 as level, pos, digest, n from {start}
         union all select g, level + 1, pos // 3, sha256(string_agg(digest, '' order by pos)), (n + 2) // 3 from {name} where n > 1 group by g, level, pos // 3, n)"""


def _beside(name: str, nodes: str) -> str:
    return f"""{name} as (select a.g, a.level, a.pos, coalesce(string_agg(b.digest, '' order by b.pos) filter (b.pos < a.pos), '') as l, coalesce(string_agg(b.digest, '' order by b.pos) filter (b.pos > a.pos), '') as r
         from {nodes} a join {nodes} b on a.g = b.g and a.level = b.level and a.pos // 3 = b.pos // 3 where a.n > 1 group by a.g, a.level, a.pos)"""


def _fold(name: str, start: str, beside: str) -> str:
    return f"""{name} as (select id, g, 0 as level, pos, digest, proof from {start}
         union all select f.id, f.g, f.level + 1, f.pos // 3, sha256(l || f.digest || r), f.proof || l || r from {name} f join {beside} b on b.g = f.g and b.level = f.level and b.pos = f.pos)"""


_OP12 = f"""
with recursive e as (select doc_id, coalesce('=' || source, '') as g, text, {_FIELDS} as head from documents),
     leaves as (select doc_id, g, row_number() over (partition by g order by doc_id nulls first) - 1 as pos, count(*) over (partition by g) as n, sha256(head || {_enc('text')}) as digest,
        sha256(head || {_enc(f"(case when {_EVEN_CRC} then replace(text, chr(10), '') else text end)")}) as changed from e),
     {_up('own', 'leaves')},
     subroots as (select g as s, row_number() over (order by g) - 1 as pos, count(*) over () as n, digest, '' as g from own where n = 1),
     {_up('high', 'subroots')},
     root as (select digest as root from high where n = 1),
     {_beside('own_beside', 'own')}, {_beside('high_beside', 'high')},
     {_fold('low', "(select doc_id as id, g, pos, changed as digest, '' as proof from leaves)", 'own_beside')},
     turned as (select id, digest, proof, pos, '' as g from (select low.id, s.pos, low.digest, low.proof, row_number() over (partition by low.id order by low.level desc) as k from low join subroots s on s.s = low.g) where k = 1),
     {_fold('last', 'turned', 'high_beside')},
     done as (select id, digest, proof from (select *, row_number() over (partition by id order by level desc) as k from last) where k = 1)
select doc_id, l.digest as leaf, s.digest as subroot, root, sha256(proof) as proof_sha256, d.digest as folded_root, d.digest = root as verified
from leaves l join subroots s on s.s = l.g join done d on d.id = l.doc_id, root
"""

_OP13 = """
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
     w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
     n as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
     f as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase, count(*) as f from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from w, range(1, 5) t(m) where len(w) >= m) group by all having count(*) >= 30),
     c as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from f where m > 1),
     s as (select lang, a, array_to_string(w[i:i + k - 1], ' ') as phrase from (select lang, a, w, k, unnest(range(1, m - k + 2)) as i from c, range(2, 4) t(k) where m > k)),
     x as (select lang, phrase, max(a) as most from s group by all),
     k as (select c.lang, c.phrase, a, w, m, unnest(range(1, m)) as k from c left join x using (lang, phrase) where most is null or 100 * most < 80 * a),
     d as (select k.lang, k.phrase, a, k, l.f as l, r.f as r, cast((2000000 * cast(a as hugeint)) // (l.f + r.f) as bigint) as score
           from k join f l on l.lang = k.lang and l.phrase = array_to_string(w[1:k], ' ') join f r on r.lang = k.lang and r.phrase = array_to_string(w[k + 1:], ' ')),
     b as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as o from d) where o = 1),
     t as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b)
select lang, rank, phrase, a, l, r, n, score from t join n using (lang) where rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": _OP2, "op3_url_rules": _OP3, "op8_embeddings": _OP8, "op10_decontaminate": _OP10, "op12_manifest": _OP12, "op13_collocations": _OP13}
