"""Keyed updates of Parquet tables: new versions as queries, then an atomic swap."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .grouping import keep_last


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The old rows whose keys ``new`` lacks, and the new ones (of equal keys the first in ``order``)."""
    last = keep_last(new, keys, order) if order else new
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def guarded(new: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """New (key, value) rows without those whose value another key already has."""
    taken = known.select(F.col(value), F.col(key).alias("__key"))
    return new.join(taken, (new[value] == taken[value]) & (new[key] != taken["__key"]), "left_anti")


def fill_null(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``old`` with nulls of ``column`` filled from ``new``, which has one row a key."""
    fresh = new.select(*keys, F.col(column).alias("__new"))
    return old.join(fresh, keys, "left").withColumn(column, F.coalesce(F.col(column), F.col("__new"))).drop("__new")


def replace_table(df: DataFrame, path: str) -> None:
    """Writes ``df`` beside ``path`` and then swaps it in, so that readers see the old table or the new one.

    ``df`` may read the table it replaces.
    """
    spark: SparkSession = df.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        fs.rename(at, hadoop.Path(old))
    fs.rename(hadoop.Path(fresh), at)
    fs.delete(hadoop.Path(old), True)


def overwrite_seasons(df: DataFrame, path: str) -> None:
    """Replaces the seasons that ``df`` has, one partition each, and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)


def create_as(df: DataFrame, table: str, drop: bool = False, partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> None:
    """A new table of the rows of ``df``; an old one is dropped first or is an error.

    Partitions and the order within files stand in for indexes.
    """
    if drop:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    rows = df.sortWithinPartitions(*(partition_by or []), *sort_by) if sort_by else df
    writer = rows.write.mode("errorifexists").format("parquet")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)


def truncate_append(df: DataFrame, table: str) -> None:
    """Replaces all rows of a table and keeps its columns and their types; without the table it is created.

    Columns are matched by name; those that ``df`` lacks are null.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        create_as(df, table)
        return
    schema = spark.table(table).schema
    rows = df.select(*(F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").insertInto(table, overwrite=True)
