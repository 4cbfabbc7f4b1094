"""Quantile buckets, histograms and correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import quantile_edges


def bucket_of(value: Column, edges: Column) -> Column:
    """The right-closed bucket, from 0, that holds the value; the lowest edge belongs to bucket 0."""
    below = F.size(F.filter(edges, lambda e: e < value))
    return F.when(value.isNotNull(), F.greatest(below - 1, F.lit(0)))


def qcut(df: DataFrame, value: str, parts: int, name: str, keys: list[str] | None = None, distinct: bool = False) -> DataFrame:
    """``name``: equal-frequency bucket; ties at an edge share a bucket."""
    edges = quantile_edges(df, value, [k / parts for k in range(parts + 1)], keys, distinct)
    both = df.join(edges, keys, "left") if keys else df.join(F.broadcast(edges), how="left")
    return both.withColumn(name, bucket_of(F.col(value), F.col("edges"))).drop("edges")


def bucket_stats(df: DataFrame, bucket: str, value: str) -> DataFrame:
    """Number, extremes, mean and sample deviation of the values by bucket."""
    v = F.col(value)
    return df.groupBy(bucket).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))


def histogram(df: DataFrame, value: str, low: float, width: float, bins: int) -> DataFrame:
    """(bin, n) of values from ``low`` on; the last bin also holds its upper edge."""
    v = F.col(value)
    k = F.least(F.floor((v - low) / width), F.lit(bins - 1))
    return df.where((v >= low) & (v <= low + width * bins)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, corr) of every pair of columns, rows with a null in either left out, in one pass."""
    pairs = list(combinations(columns, 2))

    def corr(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))  # null, not an error, for a constant

    row = df.agg(*(corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs))).alias("c")).select("c.*")


def share_over(value: Column, keys: list[str]) -> Column:
    """The value's share of its group's sum."""
    return F.try_divide(value, F.sum(value).over(Window.partitionBy(*keys)))
