"""Grouped picks, shares and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def primary_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order, which must leave no ties."""
    ranked = df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__k = 1").drop("__k")


def mode_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each group's most frequent value and its count ``n``; ties go to the smallest value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return primary_row(counts, keys, [F.desc("n"), F.asc(value)])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number of rows ``n``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, which fails when run if a key has more than one row."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("__ok", F.assert_true(n == 1, f"duplicate keys {keys}")).where(F.col("__ok").isNull()).drop("__ok")


def shares(df: DataFrame, value: str, within: list[str], name: str, scale: float = 100.0, digits: int | None = 2) -> DataFrame:
    """``name``: each row's value as a share of its group's total, of ``scale``."""
    total = F.sum(value).over(Window.partitionBy(*within))
    share = F.try_divide(F.col(value) * scale, total)
    return df.withColumn(name, share if digits is None else F.round(share, digits))


def weighted_mean(value: Column, weight: Column, empty: float | None = 0.0) -> Column:
    """Aggregate: the mean of the non-null values of positive weight."""
    used = value.isNotNull() & (weight > 0)
    mean = F.try_divide(F.sum(F.when(used, value * weight)), F.sum(F.when(used, weight)))
    return mean if empty is None else F.coalesce(mean, F.lit(empty))


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last in the given order."""
    return primary_row(df, keys, order)


def duplicate_suffix(place: Column) -> Column:
    """The letters after the id of its ``place``-th row: none for the first, "b" for the second, "aa" after "z"."""
    letter = lambda k: F.chr(k.cast("long"))
    two = F.concat(letter(96 + F.floor((place - 1) / 26)), letter(97 + (place - 1) % 26))
    return F.when(place == 1, "").when(place <= 26, letter(96 + place)).otherwise(two)
