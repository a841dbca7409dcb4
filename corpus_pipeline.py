"""From raw documents to token ids: quality, near duplicates, benchmark passages, personal data, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns a DataFrame that is
written as Parquet and read again for the next one. All but the last return the columns of documents; further columns,
whatever their names, stay as they are. A null text counts as empty, and null and empty texts stay in every stage, but
for near duplicates, of which those without words are one group. Rows without a doc_id stay in all stages. Rows that
repeat each other stay or go together, but for near duplicates, which keep one row of each doc_id. Texts of any length are
taken whole. An empty table gives an empty result, and so do empty labels or an empty benchmark leave all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, pii, quality, simhash
from quarry.llm.queries import tokenizer
from quarry.llm.shared import discard, written
from quarry.sources.shared import shared_folder


#: Ids (8 bytes each) that are sent to all tasks at most.
MOST_SENT = 2_000_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; those unlike the target documents, toxic ones among them, go."""
    return quality.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links at a Jaccard similarity of five-word shingles of 0.8 or more: that with the smallest doc_id.

    Of rows that repeat a kept doc_id that with the smallest hash stays. Documents without an id can't stand for a group;
    they stay. Ids to leave out are broadcast while there are at most MOST_SENT; only with more, texts are shuffled.
    """
    named = simhash.near_duplicates(docs, width=5, similarity=0.8)
    stands = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = named.where("doc_id is not null").groupBy("doc_id").agg(F.max(stands).alias("kept"), F.count("*").alias("n"))
    odd = written(ids.where("not kept or n > 1").select("doc_id", "kept"))
    few = odd.count() <= MOST_SENT
    rows = docs.join(F.broadcast(odd) if few else odd, "doc_id", "left_anti")
    repeated = odd.where("kept").select("doc_id")
    if repeated.isEmpty():
        return rows
    again = docs.join(F.broadcast(repeated) if few else repeated, "doc_id", "left_semi")
    whole = F.struct(*[F.col(c) for c in docs.columns])
    first = again.groupBy("doc_id").agg(F.min_by(whole, F.struct(F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns))).alias("_row"))
    return rows.unionByName(first.select("_row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of the benchmark."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind in angle brackets and n_chars counted anew."""
    return pii.without_personal_data(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    rows = bpe.encode(docs, tokenizer(), decoded=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("bpe", encode),
]

#: Hash models, fingerprint components and merges are not SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted when the next one has been written."""
    docs, made = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if made is not None:
            discard(made)
        made = docs
    return docs
