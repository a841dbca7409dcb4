"""Index tables over chunks: postings, token and corpus statistics, hashed and dense vectors, status."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.sources.tables import drop_table, write_table


def postings(chunks: DataFrame, id_col: str = "chunk_id", tokens_col: str = "tokens") -> DataFrame:
    """(token, chunk_id, tf). A chunk's tokens are counted before the shuffle, which deals by token and chunk."""
    return chunks.select(F.col(id_col).alias("chunk_id"), F.explode(tokens_col).alias("token")).groupBy("token", "chunk_id").agg(F.count("*").alias("tf"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("token").agg(F.count("*").alias("df"))


def chunk_lengths(chunks: DataFrame, id_col: str = "chunk_id", tokens_col: str = "tokens") -> DataFrame:
    return chunks.select(F.col(id_col).alias("chunk_id"), F.size(tokens_col).cast("long").alias("len"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of chunks and their average length, 1.0 for an empty corpus."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("avg_len"))


def idf(df: Column, n: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def bm25_part(tf: Column, df: Column, length: Column, n: Column, avg_len: Column, k1: float = 1.4, b: float = 0.72) -> Column:
    """What one token adds to a chunk's BM25."""
    return idf(df, n) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))


def token_key(token: Column) -> Column:
    return F.xxhash64(token)


TABLES = ("postings", "blocks", "tokens", "forward", "vectors", "lengths", "attributes", "stats")


@dataclass(frozen=True)
class Index:
    """The written tables that searches read: built once, searched many times.

    postings: token, salt, chunk_id, tf, part (what the token adds to the chunk's BM25); blocks: the same lists, ordered
    by chunk and cut every so many, as token, salt, block, n, max_part, chunk_ids, parts; tokens: token, df, n_salts,
    max_part; forward: chunk_id, keys (sorted hashes of its tokens), weights (their parts); vectors: chunk_id, keys
    (sorted buckets), weights (of unit length); lengths: chunk_id, len; attributes: chunk_id and what else a hit shows;
    stats: n, avg_len. The posting list of a frequent token is cut into n_salts lists, by chunk.
    """

    postings: DataFrame
    blocks: DataFrame
    tokens: DataFrame
    forward: DataFrame
    vectors: DataFrame
    lengths: DataFrame
    attributes: DataFrame
    stats: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Index:
        return cls(*[spark.read.parquet(f"{folder}/{name}") for name in TABLES])


def build(chunks: DataFrame, folder: str, id_col: str = "chunk_id", tokens_col: str = "tokens", attributes: Sequence[str] = (), salt_rows: int = 100_000, block_rows: int = 128, dim: int = 768, k1: float = 1.4, b: float = 0.72) -> Index:
    """Writes the index of chunks below folder, in one pass over them.

    attributes: columns of chunks that hits show, or are chosen by, so that a search reads no texts. salt_rows: the longest
    posting list in one piece; block_rows: the longest block of it. A chunk's tokens are counted before the shuffle. Joins
    to a frequent token are joins of two written tables, which Spark splits.
    """
    spark = chunks.sparkSession

    def put(rows: DataFrame, name: str) -> DataFrame:
        write_table(rows, None, f"{folder}/{name}", "errorifexists")
        return spark.read.parquet(f"{folder}/{name}")

    own = put(chunks.select(F.col(id_col).alias("chunk_id"), F.col(tokens_col).alias("tokens"), F.size(tokens_col).cast("long").alias("len"), *attributes), "tokenized")
    counts = lambda: put(own.select("chunk_id", "len", F.explode("tokens").alias("token")).groupBy("token", "chunk_id", "len").agg(F.count("*").alias("tf")), "counted")
    stats, raw, _ = _together(lambda: put(corpus_stats(put(own.select("chunk_id", "len"), "lengths")), "stats"), counts, lambda: put(own.select("chunk_id", *attributes), "attributes"))
    found = put(document_frequency(raw).withColumn("n_salts", F.ceil(F.col("df") / salt_rows).cast("int")), "frequencies")
    part = bm25_part(F.col("tf"), F.col("df"), F.col("len"), F.col("n"), F.col("avg_len"), k1, b)
    salt = F.pmod(F.xxhash64("chunk_id"), F.col("n_salts").cast("long")).cast("int")
    postings = put(raw.join(found, "token").join(F.broadcast(stats)).select("token", salt.alias("salt"), "chunk_id", "tf", part.alias("part")), "postings")
    nth = F.row_number().over(Window.partitionBy("token", "salt").orderBy("chunk_id")) - 1
    entries = F.sort_array(F.collect_list(F.struct("chunk_id", "part")))
    blocks = postings.withColumn("block", F.floor(nth / block_rows).cast("int")).groupBy("token", "salt", "block").agg(F.count("*").alias("n"), F.max("part").alias("max_part"), entries.alias("e"))
    blocks = blocks.select("token", "salt", "block", "n", "max_part", F.col("e.chunk_id").alias("chunk_ids"), F.col("e.part").alias("parts"))
    most = postings.groupBy("token").agg(F.max("part").alias("max_part"))
    _together(
        lambda: put(blocks, "blocks"), lambda: put(found.join(most, "token"), "tokens"),
        lambda: put(keyed_lists(postings.select("chunk_id", token_key(F.col("token")).alias("key"), F.col("part").alias("weight"))), "forward"),
        lambda: put(keyed_lists(hashed_vectors(postings, dim).select("chunk_id", F.col("bucket").alias("key"), F.col("w").alias("weight"))), "vectors"),
    )
    for name in ("tokenized", "counted", "frequencies"):
        drop_table(spark, f"{folder}/{name}")
    return Index.load(spark, folder)


def _together(*jobs: Callable[[], DataFrame]) -> list[DataFrame]:
    """Jobs that don't need each other, handed to Spark at once, so that none waits for another's last task."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def keyed_lists(rows: DataFrame, by: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """rows (by, key, weight) as one row each: (by, keys in order, their weights)."""
    pairs = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("key", "weight"))).alias("p"))
    return pairs.select(*by, F.col("p.key").alias("keys"), F.col("p.weight").alias("weights"))


def bucket(token: Column, dim: int = 768) -> Column:
    """A token's bucket, from the first 32 bits of its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(max(64, dim)))


def hashed_vectors(posted: DataFrame, dim: int = 768, key: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """(key, bucket, w): counts per bucket, scaled to unit length within each key."""
    counts = posted.groupBy(*key, bucket(F.col("token"), dim).alias("bucket")).agg(F.sum("tf").cast("double").alias("c"))
    norms = counts.groupBy(*key).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return counts.join(norms, list(key)).select(*key, "bucket", (F.col("c") / F.col("norm")).alias("w"))


def dense_text(label: Column, title: Column, section: Column, chunk_type: Column, metadata: Column, text: Column, chars: int = 1800) -> Column:
    names = ((("Source", label), ("Title", title), ("Section", section), ("Type", chunk_type), ("Metadata", F.array_join(F.slice(metadata, 1, 32), " "))))
    return F.substring(F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), T.text(value)) for name, value in names], T.text(text)), 1, chars)


def cache_key(provider: str, model: str, source: Column, section: Column, chunk_type: Column, dense: Column) -> Column:
    return F.concat_ws("|", F.lit(provider), F.lit(model), source, section, chunk_type, F.substring(F.sha1(F.encode(dense, "UTF-8")), 1, 18))


def unit(vector: Column) -> Column:
    """A vector scaled to length 1, empty if it has no length."""
    values = F.transform(vector, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v))
    return F.when(norm > 0, F.transform(values, lambda v: v / norm)).otherwise(F.array().cast("array<double>"))


def cached_vectors(keyed: DataFrame, cache: DataFrame, key_col: str = "key") -> DataFrame:
    """keyed with `values`, empty where the cache has none."""
    return keyed.join(cache.select(F.col("key").alias(key_col), "values"), key_col, "left").withColumn("values", F.coalesce("values", F.array().cast("array<double>")))


def missing_batches(keyed: DataFrame, cache: DataFrame, size: int = 24, most: int = 0, key_col: str = "key") -> DataFrame:
    """Keys that the cache lacks, in batches (batch_no) of about `size`, dealt by hash so that no task numbers them all.

    most: only so many, those of smallest key; 0 for all.
    """
    rows = keyed.join(cache.select(F.col("key").alias(key_col)), key_col, "left_anti").dropDuplicates([key_col])
    if most:
        rows = rows.orderBy(key_col).limit(most)
    total = rows.count()
    return rows.withColumn("batch_no", F.pmod(F.xxhash64(key_col), F.lit(max(1, -(-total // size)))))


def embed_missing(missing: DataFrame, embed: Callable[[list[str]], list[list[float]]], key_col: str = "key", text_col: str = "dense_text", size: int = 24) -> DataFrame:
    """(key, values) of the missing rows by a user's function over lists of texts; it must return as many vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                values = embed(part[text_col].tolist())
                if len(values) != len(part):
                    raise ValueError(f"embedder returned {len(values)} vectors for {len(part)} texts")
                yield pd.DataFrame({"key": part[key_col].tolist(), "values": [[float(v) for v in x] for x in values]})

    return missing.select(key_col, text_col).mapInPandas(run, "key string, values array<double>").withColumn("values", unit(F.col("values"))).where(F.size("values") > 0)


def status(chunks: DataFrame, posted: DataFrame) -> DataFrame:
    """One row of counts over chunks (path, chunk_type, metadata) and their postings."""
    own = chunks.agg(
        F.countDistinct("path").alias("n_files"), F.count("*").alias("n_chunks"), *[F.count_if(F.col("chunk_type") == kind).alias(f"n_{kind}") for kind in ("section_summary", "recommendation", "text", "table_row")],
        F.count_if(F.size("metadata") > 0).alias("n_tagged"), F.count_if(F.exists("metadata", lambda m: m.startswith("ontology:"))).alias("n_ontology"),
    )
    words = posted.agg(F.countDistinct("token").alias("n_tokens"), F.countDistinct("chunk_id").alias("n_vectors"))
    return own.join(words)


def status_by_label(files: DataFrame, label_col: str = "label") -> DataFrame:
    """Per label of files (path): number of files and of folders, and the folders, sorted."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.groupBy(label_col).agg(F.countDistinct("path").alias("n_files"), F.countDistinct(folder).alias("n_folders"), F.array_join(F.sort_array(F.collect_set(folder)), ",").alias("folders"))
