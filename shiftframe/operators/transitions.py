"""Season-to-season role transitions: pairs, smoothed rates, splits, probability tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftframe.functions.seasons import season_next

from .grouping import keep_last, require_unique

ROLES = (0, 1, 2)


def season_parts(df: DataFrame, test_season: int | None = None) -> DataFrame:
    """``df`` with part: "test" for the season given, or for the last one; "train" otherwise."""
    last = df.agg(F.max("season").alias("__last")) if test_season is None else df.sparkSession.range(1).select(F.lit(test_season).alias("__last"))
    return df.join(F.broadcast(last)).withColumn("part", F.when(F.col("season") == F.col("__last"), "test").otherwise("train")).drop("__last")


def transition_pairs(df: DataFrame) -> DataFrame:
    """Each player-season with the player's role of the next season; gaps give no pair."""
    after = df.select(F.col("player_id"), F.col("season").alias("season_t1"), F.col("cluster").alias("cluster_t1"))
    now = df.withColumn("season_t1", season_next(F.col("season")))
    return now.join(after, ["player_id", "season_t1"])


def transition_pairs_dedup(df: DataFrame, order: list[Column]) -> DataFrame:
    """The same with one next season for each player, the first in ``order``; fails on a second."""
    after = keep_last(df, ["player_id", "season"], order).select("player_id", F.col("season").alias("season_t1"), F.col("cluster").alias("cluster_t1"))
    after = require_unique(after, ["player_id", "season_t1"])
    return df.withColumn("season_t1", season_next(F.col("season"))).join(after, ["player_id", "season_t1"])


def dirichlet(pairs: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(pos_group, from_cluster, to_cluster, n, prob_mean): mean transition rates under a Dirichlet prior.

    Every from and to role has a row; a role never left has uniform rates.
    """
    roles = F.array(*(F.lit(r).cast("long") for r in ROLES))
    grid = pairs.select("pos_group").distinct().select("pos_group", F.explode(roles).alias("from_cluster")).select("*", F.explode(roles).alias("to_cluster"))
    counts = pairs.groupBy("pos_group", F.col("cluster").alias("from_cluster"), F.col("cluster_t1").alias("to_cluster")).agg(F.count("*").alias("n"))
    full = grid.join(counts, ["pos_group", "from_cluster", "to_cluster"], "left").na.fill(0, ["n"])
    total = F.sum(F.col("n") + alpha).over(Window.partitionBy("pos_group", "from_cluster"))
    return full.withColumn("prob_mean", (F.col("n") + alpha) / total)


def renormalised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Probability columns scaled to a sum of 1; null where the sum is 0 or null."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0.0)))
    return df.withColumns({c: F.try_divide(F.coalesce(F.col(c), F.lit(0.0)), total) for c in columns})
