"""Named SQL checks over registered tables, each run on its own."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .grouping import duplicate_keys


@dataclass(frozen=True)
class Outcome:
    name: str
    columns: tuple[str, ...]
    rows: tuple[Row, ...]
    error: str | None = None


def statements(text: str) -> list[str]:
    """The statements of an SQL text: comments dropped, parted by semicolons outside quotes."""
    text = re.sub(r"--[^\n]*", "", text)
    return [s.strip() for s in re.findall(r"(?:'(?:[^']|'')*'|[^;'])+", text) if s.strip()]


def run_checks(spark: SparkSession, checks: dict[str, str], limit: int = 50, stop: bool = False) -> list[Outcome]:
    """Each check's first rows; a check that fails gives its error, and the others still run unless ``stop``."""
    out = []
    for name, text in checks.items():
        try:
            for k, statement in enumerate(statements(text)):
                df = spark.sql(statement)
                out.append(Outcome(f"{name}:{k}", tuple(df.columns), tuple(df.limit(limit).collect())))
        except PySparkException as error:
            if stop:
                raise
            out.append(Outcome(name, (), (), str(error).splitlines()[0]))
    return out


def require(df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """``df`` if its keys are unique and, if given, it has so many rows; raises otherwise."""
    if example := duplicate_keys(df, keys).first():
        raise ValueError(f"duplicate key {example.asDict()}")
    if rows is not None and (found := df.count()) != rows:
        raise ValueError(f"{found} rows, not {rows}")
    return df


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the nulls of each column."""
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))


def match_rate(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the rows of both sides, and those of their join on the keys.

    A key's rows of either side are counted in one grouping; its joined rows are the product. Null keys match nothing.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    sides = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    counts = sides.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return counts.agg(n("l").alias("n_left"), n("r").alias("n_right"), n(F.when(whole, F.col("l") * F.col("r"))).alias("n_matched"))
