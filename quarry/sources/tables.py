"""Tables behind JDBC or in Parquet: index and hit tables, session and user tables with upserts by key."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quarry.sources.shared import shared_folder

#: Ids that go to all tasks at most.
FEW = 200_000


def read_table(spark: SparkSession, url: str | None, table: str, **options: str) -> DataFrame:
    """A table by JDBC, or, without a url, the Parquet folder `table`."""
    if url is None:
        return spark.read.parquet(table)
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_table(rows: DataFrame, url: str | None, table: str, mode: str = "append", by: Sequence[str] = (), **options: str) -> None:
    """rows into a table by JDBC, or, without a url, into the Parquet folder `table`, in folders by the columns `by`."""
    if url is None:
        rows.write.mode(mode).partitionBy(*by).parquet(table)
    else:
        rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def read_partitioned(spark: SparkSession, url: str, table: str, column: str, parts: int, **options: str) -> DataFrame:
    """A table by JDBC in so many ranges of an integer, date or time column, each read by a task of its own.

    The column's ends are asked of the database first; rows where it is null come with the first range.
    """
    ends = spark.read.format("jdbc").options(url=url, query=f'select min("{column}") as "a", max("{column}") as "b" from {table}', **options).load().first()
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if ends.a is not None and parts > 1:
        reader = reader.options(partitionColumn=column, lowerBound=str(ends.a), upperBound=str(ends.b), numPartitions=parts)
    return reader.load()


def merge_batch(new: DataFrame, batch: int, url: str, table: str, key: str, order: str, types: str, **options: str) -> None:
    """Brings a stream's batch into a database table by key: for foreachBatch.

    Tasks write the batch, a row for each key, into a staging table; then one transaction merges that into the table, the
    row of the largest order winning, new before old on a tie, and notes the batch's number. A repeated batch, or one that
    failed halfway, thus changes nothing twice. types: the columns' types as the database names them.
    """
    spark = new.sparkSession
    stage, noted = f"{table}_stage", f"{table}_batches"
    how = {"createTableColumnTypes": types, **options}
    if not _has_table(spark, url, table):
        new.limit(0).write.format("jdbc").options(url=url, dbtable=table, **how).save()
    if not _has_table(spark, url, noted):
        new.limit(0).selectExpr("cast(0 as bigint) as batch").write.format("jdbc").options(url=url, dbtable=noted, **options).save()
    if spark.read.format("jdbc").options(url=url, query=f'select count(*) as "n" from {noted} where "batch" = {int(batch)}', **options).load().first().n:
        return
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")
    last.write.format("jdbc").options(url=url, dbtable=stage, **how).mode("overwrite").save()
    q = lambda name, of: f'{of}."{name}"'
    columns = new.columns
    merge = (
        f"merge into {table} t using {stage} s on {q(key, 't')} = {q(key, 's')} "
        f"when matched and {q(order, 's')} >= {q(order, 't')} then update set {', '.join(f'"{c}" = {q(c, 's')}' for c in columns if c != key)} "
        f"when not matched then insert ({', '.join(f'"{c}"' for c in columns)}) values ({', '.join(q(c, 's') for c in columns)})"
    )
    _run(spark, url, merge, f"insert into {noted} values ({int(batch)})")


def _connected(spark: SparkSession, url: str):
    return spark._jvm.java.sql.DriverManager.getConnection(url)


def _has_table(spark: SparkSession, url: str, table: str) -> bool:
    with_ = _connected(spark, url)
    try:
        found = with_.getMetaData().getTables(None, None, None, None)
        while found.next():
            if found.getString("TABLE_NAME").lower() == table.lower():
                return True
        return False
    finally:
        with_.close()


def _run(spark: SparkSession, url: str, *statements: str) -> None:
    """Statements in one transaction of the database."""
    with_ = _connected(spark, url)
    try:
        with_.setAutoCommit(False)
        for statement in statements:
            with_.createStatement().executeUpdate(statement)
        with_.commit()
    except Exception:
        with_.rollback()
        raise
    finally:
        with_.close()


def kept(rows: DataFrame) -> DataFrame:
    """rows from a table in the shared folder: what follows reads them, and no executor's loss makes them anew."""
    folder = shared_folder(rows.sparkSession)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def fetched(table: DataFrame, ids: DataFrame, id_col: str, most: int = 256) -> DataFrame:
    """The rows of a table whose id is among ids (id_col), for ids that are few against it.

    Integer ids are first told apart into at most `most` ranges, which reach the scan, so that row groups between them,
    whose statistics show it, aren't read; then a join picks the rows. Up to FEW ids go to all tasks, so that the table isn't
    shuffled.
    """
    wanted = ids.select(id_col).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    if isinstance(table.schema[id_col].dataType, IntegralType):
        ends = ids.agg(F.min(id_col).alias("a"), F.max(id_col).alias("b")).first()
        if ends.a is None:
            return table.limit(0)
        width = (ends.b - ends.a) // most + 1
        found = ids.groupBy(F.expr(f"(cast({id_col} as decimal(20, 0)) - {ends.a}) div {width}").alias("r")).agg(F.min(id_col).alias("a"), F.max(id_col).alias("b")).collect()
        table = table.where(reduce(or_, [F.col(id_col).between(r.a, r.b) for r in found]))
    return table.join(wanted, id_col, "left_semi")


def drop_table(spark: SparkSession, folder: str) -> None:
    """Deletes a Parquet folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old with new: per key the row of the largest order, new before old on a tie."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc(), F.col("_new").desc()))).where("_n = 1").drop("_n", "_new")


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The complete versions of a table, in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return []
    found = [s.getPath() for s in store.listStatus(where)]
    return sorted(int(p.getName()[1:]) for p in found if re.fullmatch("v[0-9]+", p.getName()) and store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_latest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The last complete version of a table that upsert_batch() keeps, or the last one below `before`; None if there is none."""
    found = [v for v in _versions(spark, folder) if before is None or v < before]
    return spark.read.parquet(f"{folder}/v{found[-1]}") if found else None


def last_version(spark: SparkSession, folder: str) -> int:
    """The number of a table's last complete version, -1 if there is none."""
    return max(_versions(spark, folder), default=-1)


def write_version(rows: DataFrame, number: int, folder: str) -> None:
    """A version of a small table, beside those before it; the last two stay."""
    spark = rows.sparkSession
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/v{number}")
    for v in _versions(spark, folder):
        if v < number - 1:
            drop_table(spark, f"{folder}/v{v}")


def upsert_batch(new: DataFrame, batch: int, folder: str, key: str, order: str) -> None:
    """Brings a stream's batch into a table: for foreachBatch. Each batch is a version made from the one before it.

    A repeated batch gives the same version again. Readers keep the version that they have opened: the last two stay.
    """
    spark = new.sparkSession
    old = read_latest(spark, folder, before=batch)
    upserted(new.limit(0) if old is None else old, new, key, order).write.mode("overwrite").parquet(f"{folder}/v{batch}")
    for v in _versions(spark, folder):
        if v < batch - 1:
            drop_table(spark, f"{folder}/v{v}")
