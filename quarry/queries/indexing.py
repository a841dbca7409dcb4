"""Index tables over the documents, vectors over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import index as I
from quarry.operators import retrieve as R
from quarry.operators.growing import GrowingIndex
from quarry.queries.shared import lit, read, sql_tokens
from quarry.queries.tagging import _CAPTURED, _HAY, ONTOLOGY, _docs, _metadata, sql_values
from quarry.operators.rules import Rules
from quarry.sources.shared import shared_folder


def doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), T.tokenize("text").alias("tokens"))


def i1_postings(spark: SparkSession, d: str) -> DataFrame:
    return I.postings(doc_tokens(spark, d))


def i2_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return I.document_frequency(I.postings(doc_tokens(spark, d)))


def i3_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return I.corpus_stats(I.chunk_lengths(doc_tokens(spark, d))).select("n", F.round("avg_len", 6).alias("avg_len"))


def i4_idf(spark: SparkSession, d: str) -> DataFrame:
    tokens = doc_tokens(spark, d)
    df, stats = I.document_frequency(I.postings(tokens)), I.corpus_stats(I.chunk_lengths(tokens))
    return df.join(F.broadcast(stats)).select("token", F.round(I.idf(F.col("df"), F.col("n")), 6).alias("idf"))


def i5_hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = I.hashed_vectors(I.postings(doc_tokens(spark, d)))
    return rows.select("chunk_id", "bucket", F.round("w", 6).alias("w"))


def _dense(spark: SparkSession, d: str) -> DataFrame:
    meta = F.array(F.concat(F.lit("lang:"), "lang"), F.lit("chunk_type:text"))
    dense = I.dense_text(F.col("source"), F.col("doc_id").cast("string"), F.col("lang"), F.lit("text"), meta, F.col("text"))
    return read(spark, d, "documents").select("doc_id", dense.alias("dense_text"), I.cache_key("local", "stub", F.col("source"), F.col("lang"), F.lit("text"), dense).alias("key"))


def i6_dense_text(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).select("doc_id", F.sha1("dense_text").alias("text_sha1"), "key")


def _cache(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.concat(F.lit("k"), F.col("vec_id").cast("string")).alias("key"), F.col("embedding").cast("array<double>").alias("values"))


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), "text")


def i7_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    found = I.cached_vectors(_keyed(spark, d), _cache(spark, d))
    return found.select("doc_id", F.size("values").cast("long").alias("dims"), F.round(F.coalesce(F.get("values", F.lit(0)), F.lit(0.0)), 6).alias("v0"))


def i7_missing(spark: SparkSession, d: str) -> DataFrame:
    return I.missing_batches(_keyed(spark, d), _cache(spark, d)).select("key")


def i8_unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "embeddings").select("vec_id", I.unit(F.transform("embedding", lambda v: v * F.lit(3.0))).alias("u"))
    # a small negative number stays negative zero: round() and format_number() would lose its sign
    near = lambda v: F.signum(v) * (F.floor(F.abs(v) * 1e5 + 0.5).cast("double") / 1e5)
    return rows.select("vec_id", F.array_join(F.transform("u", lambda v: F.format_string("%.5f", near(v))), " ").alias("unit"))


def _stub(texts: list[str]) -> list[list[float]]:
    """An embedder for tests: letter counts."""
    return [[float(t.count(c)) for c in "aeiou "] for t in texts]


def i9_embed_missing(spark: SparkSession, d: str) -> DataFrame:
    """Missing keys embedded by the stub and merged with the cache."""
    rows = _keyed(spark, d).withColumnRenamed("text", "dense_text")
    new = I.embed_missing(I.missing_batches(rows, _cache(spark, d)), _stub)
    return _cache(spark, d).unionByName(new).select("key", F.size("values").cast("long").alias("dims"))


def i9_filled_cache(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as a cache in the shared folder, filled with the documents' vectors, and asked once more: nothing is left to make."""
    from quarry.sources import vectors

    rows = _keyed(spark, d).select("key", F.col("text").alias("dense_text"))
    path = vectors.write_cache(_cache(spark, d))[1]
    vectors.fill_cache(rows, path, _stub)
    found = vectors.fill_cache(rows, path, _refuse)
    return found.select("key", F.size("values").cast("long").alias("dims"))


def _refuse(texts: list[str]) -> list[list[float]]:
    """Embeds texts without a letter that counts, and no other: those are the only ones that a full cache lacks."""
    if any(v for x in _stub(texts) for v in x):
        raise ValueError("a cached text was asked for again")
    return _stub(texts)


def i1_growing_index(spark: SparkSession, d: str) -> DataFrame:
    """An index of most documents, to which a hundredth is added and from which a hundredth is deleted: each benchmark text's best five."""
    grown = GrowingIndex(spark, shared_folder(spark))
    docs = doc_tokens(spark, d)
    grown.add(docs.where("chunk_id % 100 <> 7"))
    grown.add(docs.where("chunk_id % 100 = 7"))
    grown.delete(docs.where("chunk_id % 100 = 3").select("chunk_id"))
    asked = R.query_tokens(read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(0).cast("long").alias("variant_no"), "text"), T.tokenize("text"))
    return R.top(R.combined(grown.bm25(asked)), 5).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def i10_status(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.lit("text").alias("chunk_type"), _metadata().alias("metadata"))
    return I.status(rows, I.postings(doc_tokens(spark, d)))


def i11_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("lang").alias("label"))
    return I.status_by_label(rows)


def s3_vector_cache(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings written as a JSONL cache, with a repeated key, and read back."""
    from quarry.sources import vectors

    rows = read(spark, d, "embeddings").select(F.concat(F.lit("k"), F.col("vec_id").cast("string")).alias("key"), F.transform("embedding", lambda v: F.round(v.cast("double"), 4)).alias("values"))
    found = vectors.read_cache(vectors.write_cache(rows))
    return found.select("key", F.size("values").cast("long").alias("dims"), F.round(F.get("values", F.lit(3)), 4).alias("v3"))


QUERIES = (i1_postings, i2_doc_freq, i3_corpus_stats, i4_idf, i5_hashed_vectors, i6_dense_text, i7_cache_lookup, i7_missing, i8_unit_vectors, i9_embed_missing, i9_filled_cache, i1_growing_index, i10_status, i11_labels, s3_vector_cache)

SQL_INDEX = f"""docs as (select doc_id as chunk_id, {sql_tokens('text')} as tokens from documents),
    post as (select token, chunk_id, count(*) as tf from (select chunk_id, unnest(tokens) as token from docs) group by all),
    df as (select token, count(*) as df from post group by token),
    lens as (select chunk_id, len(tokens) as len from docs),
    stats as (select count(*) as n, coalesce(avg(len), 1.0) as avg_len from lens)"""
_DENSE = "substr('Source: ' || source || chr(10) || 'Title: ' || doc_id || chr(10) || 'Section: ' || lang || chr(10) || 'Type: text' || chr(10) || 'Metadata: lang:' || lang || ' chunk_type:text' || chr(10) || text, 1, 1800)"

SQL = {
    "i1_postings": f"with {SQL_INDEX} select token, chunk_id, tf from post",
    "i2_doc_freq": f"with {SQL_INDEX} select token, df from df",
    "i3_corpus_stats": f"with {SQL_INDEX} select n, round(avg_len, 6) as avg_len from stats",
    "i4_idf": f"with {SQL_INDEX} select token, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from df, stats",
    "i5_hashed_vectors": f"""with {SQL_INDEX}, c as (select chunk_id, cast(('0x' || substr(md5(token), 1, 8))::bigint % 768 as bigint) as bucket, cast(sum(tf) as double) as c from post group by all)
        select chunk_id, bucket, round(c / sqrt(sum(c * c) over (partition by chunk_id)), 6) as w from c""",
    "i6_dense_text": f"select doc_id, sha1({_DENSE}) as text_sha1, 'local|stub|' || source || '|' || lang || '|text|' || substr(sha1({_DENSE}), 1, 18) as key from documents",
    "i7_cache_lookup": "select doc_id, cast(coalesce(len(embedding), 0) as bigint) as dims, round(coalesce(cast(embedding[1] as double), 0.0), 6) as v0 from documents left join embeddings on vec_id = doc_id",
    "i7_missing": "select distinct 'k' || doc_id as key from documents where doc_id not in (select vec_id from embeddings)",
    "i8_unit_vectors": """with s as (select vec_id, list_transform(embedding, lambda v: cast(v as double) * 3) as e from embeddings)
        select vec_id, array_to_string(list_transform(e, lambda v: printf('%.5f', round(v / sqrt(list_sum(list_transform(e, lambda w: w * w))), 5))), ' ') as unit from s""",
    "i9_embed_missing": """select 'k' || vec_id as key, cast(len(embedding) as bigint) as dims from embeddings
        union all select distinct 'k' || doc_id, 6 from documents where doc_id not in (select vec_id from embeddings) and regexp_matches(text, '[aeiou ]')""",
    "i9_filled_cache": """select 'k' || vec_id as key, cast(len(embedding) as bigint) as dims from embeddings
        union all select distinct 'k' || doc_id, 6 from documents where doc_id not in (select vec_id from embeddings) and regexp_matches(text, '[aeiou ]')""",
    "i1_growing_index": f"""with {SQL_INDEX.replace("from documents)", "from documents where doc_id % 100 <> 3)", 1)}, asked as (select item_id as query_id, unnest(list_distinct({sql_tokens('text')})) as token from benchmark),
        s as (select query_id, post.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (1 - 0.72 + 0.72 * len / avg_len))), 6) as score from asked join df using (token) join post using (token) join lens on lens.chunk_id = post.chunk_id, stats group by all)
        select query_id, chunk_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s where score > 0) where rank <= 5""",
    "i10_status": f"""with {SQL_INDEX}, {_HAY}, o as (select len({sql_values(Rules(ONTOLOGY), True)}) as n_o, len({_CAPTURED}) as n_c from h)
        select count(*) as n_files, count(*) as n_chunks, cast(0 as bigint) as n_section_summary, cast(0 as bigint) as n_recommendation, count(*) as n_text, cast(0 as bigint) as n_table_row,
          count(*) filter (n_c > 0) as n_tagged, count(*) filter (n_o > 0) as n_ontology, (select count(*) from df) as n_tokens, (select count(distinct chunk_id) from post) as n_vectors from o""",
    "i11_labels": "select lang as label, count(distinct doc_id) as n_files, count(distinct source) as n_folders, string_agg(distinct source || '/' || lang, ',' order by source || '/' || lang) as folders from documents group by lang",
    "s3_vector_cache": """with r as (select vec_id, list_transform(embedding, lambda v: round(cast(v as double), 4)) as e from embeddings)
        select 'k' || vec_id as key, cast(len(e) as bigint) as dims, round(e[4] / sqrt(list_sum(list_transform(e, lambda w: w * w))), 4) as v3 from r""",
}
