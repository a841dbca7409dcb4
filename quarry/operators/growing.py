"""An index that grows: segments of postings, tombstones, and a merge.

Adding chunks writes a segment of their postings alone; deleting writes their ids and how much each token's document
frequency falls. Nothing is computed from the whole corpus when a segment is written, so a segment's size is that of what
changed. A search takes frequencies and statistics as sums over segments and tombstones, and weighs the posting lists of
its own tokens with them; its scores equal those of an index built anew. merge() rewrites all as one segment.

Each change ends with a new version, a table of the names that make up the index; readers keep the version they opened,
and a change that fails leaves the last one in place. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.index import bm25_part
from quarry.operators.retrieve import QV
from quarry.sources.tables import drop_table, kept, last_version, read_latest, write_version

_STATS = "n long, total long"


class GrowingIndex:
    """The index below a folder; add() and delete() may be called in any order, also on an empty folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _parts(self, kind: str) -> list[tuple[int, str]]:
        rows = read_latest(self.spark, f"{self.folder}/versions")
        return sorted((r.seq, r.name) for r in rows.where(F.col("kind") == kind).collect()) if rows is not None else []

    def _next(self) -> int:
        return last_version(self.spark, f"{self.folder}/versions") + 1

    def _note(self, seq: int, parts: Sequence[tuple[str, int, str]]) -> None:
        write_version(self.spark.createDataFrame([*parts], "kind string, seq long, name string"), seq, f"{self.folder}/versions")

    def _all(self) -> list[tuple[str, int, str]]:
        return [(kind, *p) for kind in ("segment", "tombstones") for p in self._parts(kind)]

    def _union(self, kind: str, table: str, schema: str) -> DataFrame:
        """A table of all parts of a kind, with the number of its part."""
        out = self.spark.createDataFrame([], f"{schema}, seq long")
        for i, (seq, name) in enumerate(self._parts(kind)):
            rows = self.spark.read.parquet(f"{self.folder}/{name}/{table}").withColumn("seq", F.lit(seq).cast("long"))
            out = rows if i == 0 else out.unionByName(rows)
        return out

    def add(self, chunks: DataFrame) -> str:
        """Adds chunks (chunk_id, tokens), whose ids mustn't be in the index; the name of the segment."""
        seq = self._next()
        name = f"segment{seq}"
        own = kept(chunks.select("chunk_id", "tokens", F.size("tokens").cast("long").alias("len")))
        counted = own.select("chunk_id", "len", F.explode("tokens").alias("token")).groupBy("token", "chunk_id", "len").agg(F.count("*").alias("tf"))
        self._write(name, counted, own.select("chunk_id", "len"))
        self._note(seq, [*self._all(), ("segment", seq, name)])
        return name

    def _write(self, name: str, counted: DataFrame, lengths: DataFrame) -> None:
        counted.write.mode("overwrite").parquet(f"{self.folder}/{name}/postings")
        lengths.write.mode("overwrite").parquet(f"{self.folder}/{name}/lengths")
        read = lambda table: self.spark.read.parquet(f"{self.folder}/{name}/{table}")
        read("postings").groupBy("token").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{self.folder}/{name}/frequencies")
        read("lengths").agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).write.mode("overwrite").parquet(f"{self.folder}/{name}/stats")

    def delete(self, ids: DataFrame) -> str:
        """Deletes the chunks whose chunk_id is among ids; unknown ids count for nothing. The name of the tombstones."""
        seq = self._next()
        name = f"tombstones{seq}"
        wanted = ids.select("chunk_id").distinct()
        gone = kept(self.lengths().join(wanted, "chunk_id", "left_semi"))
        lost = self.postings().join(gone.select("chunk_id"), "chunk_id", "left_semi").groupBy("token").agg((-F.count("*")).alias("df"))
        gone.select("chunk_id").write.mode("overwrite").parquet(f"{self.folder}/{name}/ids")
        lost.write.mode("overwrite").parquet(f"{self.folder}/{name}/frequencies")
        gone.agg((-F.count("*")).alias("n"), F.coalesce(-F.sum("len"), F.lit(0)).alias("total")).write.mode("overwrite").parquet(f"{self.folder}/{name}/stats")
        self._note(seq, [*self._all(), ("tombstones", seq, name)])
        return name

    def _live(self, rows: DataFrame) -> DataFrame:
        """rows of segments without those that a later tombstone names."""
        parts = self._parts("tombstones")
        if not parts:
            return rows.drop("seq")
        key = rows.schema["chunk_id"].dataType.simpleString()
        dead = self._union("tombstones", "ids", f"chunk_id {key}").groupBy("chunk_id").agg(F.max("seq").alias("gone"))
        return rows.join(dead, "chunk_id", "left").where(F.col("gone").isNull() | (F.col("gone") < F.col("seq"))).drop("seq", "gone")

    def postings(self) -> DataFrame:
        return self._live(self._union("segment", "postings", "token string, chunk_id long, len long, tf long"))

    def lengths(self) -> DataFrame:
        return self._live(self._union("segment", "lengths", "chunk_id long, len long"))

    def frequencies(self) -> DataFrame:
        """(token, df) of what is live: segments less tombstones."""
        every = self._union("segment", "frequencies", "token string, df long").unionByName(self._union("tombstones", "frequencies", "token string, df long"))
        return every.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")

    def stats(self) -> DataFrame:
        every = self._union("segment", "stats", _STATS).unionByName(self._union("tombstones", "stats", _STATS))
        return every.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total") / F.nullif(F.sum("n"), F.lit(0)), F.lit(1.0)).alias("avg_len"))

    def bm25(self, asked: DataFrame, k1: float = 1.4, b: float = 0.72) -> DataFrame:
        """(query_id, variant_no, chunk_id, bm25) of every live chunk with a token of the query (query_id, variant_no, token)."""
        tokens = asked.join(self.frequencies(), "token").join(F.broadcast(self.stats()))
        part = bm25_part(F.col("tf"), F.col("df"), F.col("len"), F.col("n"), F.col("avg_len"), k1, b)
        return tokens.join(self.postings(), "token").groupBy(*QV, "chunk_id").agg(F.sum(part).alias("bm25"))

    def merge(self) -> str:
        """Rewrites the live chunks as one segment, and deletes the parts before it once the new version stands."""
        seq, old = self._next(), self._all()
        name = f"segment{seq}"
        self._write(name, self.postings(), self.lengths())
        self._note(seq, [("segment", seq, name)])
        for _, _, part in old:
            drop_table(self.spark, f"{self.folder}/{part}")
        return name
