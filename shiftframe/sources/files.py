"""Files in and out: CSV by glob, archives, conformed columns, season partitions, summaries."""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, types
from pyspark.sql import functions as F

from .archives import ZipMembers


def csv_headers(spark: SparkSession, pattern: str) -> dict[str, tuple[str, ...]]:
    """The header of every CSV file that matches, by path; one line of each file is read, compressed ones too."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = at.getFileSystem(conf)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    found = fs.globStatus(at) or []
    paths = [f.getPath() for status in found for f in (fs.listStatus(status.getPath()) if status.isDirectory() else [status]) if not f.isDirectory() and not f.getPath().getName().startswith(("_", "."))]

    def header(path) -> tuple[str, ...]:
        codec, stream = codecs.getCodec(path), fs.open(path)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        try:
            line = reader.readLine() or ""
        finally:
            reader.close()
        return tuple(next(csv.reader([line.removeprefix("﻿")]), []))

    with ThreadPoolExecutor(16) as pool:
        return dict(zip([p.toString() for p in paths], pool.map(header, paths), strict=True))


def csv_files(spark: SparkSession, pattern: str, schema: types.StructType, skip: bool = False) -> DataFrame:
    """Rows of all CSV files that match, with source_file, each file read by its own header.

    A file whose header lacks a column of the schema fails, or is left out with ``skip``.
    """
    names, by_header = [f.name for f in schema], {}
    for path, header in csv_headers(spark, pattern).items():
        if missing := [n for n in names if n not in header]:
            if not skip:
                raise ValueError(f"columns {missing} are missing in {path}")
            continue
        by_header.setdefault(header, []).append(path)
    full = types.StructType([*schema, types.StructField("source_file", types.StringType())])
    out = None
    for header, paths in by_header.items():
        raw = types.StructType([types.StructField(n, types.StringType()) for n in header])
        rows = spark.read.schema(raw).option("header", True).csv(paths)
        part = conform(rows.withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)), full)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], full) if out is None else out


def snake_case(name: str, names: dict[str, str] | None = None) -> str:
    """A header as a column name: camelCase and spaces as underscores, some by ``names``."""
    name = name.strip()
    if names and name in names:
        return names[name]
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub(r"[^0-9a-zA-Z]+", "_", name).strip("_").lower()


def with_snake_headers(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    return df.toDF(*(snake_case(c, names) for c in df.columns))


def conform(df: DataFrame, schema: types.StructType, zero: tuple[str, ...] = ()) -> DataFrame:
    """The schema's columns alone, cast where they can be and null where not; ``zero`` columns get 0 for null.

    A column of the schema that is not nullable must be there.
    """
    if missing := [f.name for f in schema if not f.nullable and f.name not in df.columns]:
        raise ValueError(f"required columns {missing} are missing")

    def cast(field: types.StructField) -> Column:
        if field.name not in df.columns:
            return F.lit(None).cast(field.dataType)
        source = F.col(f"`{field.name}`")
        if isinstance(field.dataType, types.StringType):
            return F.trim(source.cast("string"))
        value = F.trim(source) if dict(df.dtypes)[field.name] == "string" else source
        value = value.try_cast(field.dataType)
        if isinstance(field.dataType, (types.DoubleType, types.FloatType)):
            value = F.when(~F.isnan(value), value)
        return F.coalesce(value, F.lit(0).cast(field.dataType)) if field.name in zero else value

    return df.select(*(cast(f).alias(f.name) for f in schema))


def zipped_csv(spark: SparkSession, pattern: str, member: str, schema: types.StructType) -> DataFrame:
    """Rows of the CSV members whose name ends with ``member`` in all archives that match, each member by a task of its own."""
    spark.dataSource.register(ZipMembers)
    members = spark.read.format("zip_members").option("path", pattern).option("member", member).option("columns", json.dumps([f.name for f in schema]))
    return conform(members.load(), schema)


def season_table(spark: SparkSession, path: str, seasons: list[int] | None = None) -> DataFrame:
    """A table partitioned by season, only the partitions asked for."""
    df = spark.read.parquet(path)
    return df if seasons is None else df.where(F.col("season").isin(seasons))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A table of few rows as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def consumed(spark: SparkSession, patterns: list[str], load: Callable[[], None]) -> list[str]:
    """Runs ``load`` and, only if it succeeds, deletes the files that matched before it ran; says which."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for pattern in patterns:
        at = jvm.org.apache.hadoop.fs.Path(pattern)
        fs = at.getFileSystem(conf)
        found += [(fs, s.getPath()) for s in fs.globStatus(at) or [] if not s.isDirectory()]
    load()
    return [path.toString() for fs, path in found if fs.delete(path, False)]
