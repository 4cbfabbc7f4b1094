"""Totals by team and by player over games."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftframe.functions.rates import per60

from .grouping import primary_row

KINDS = {"goals": "Goal", "shots": "Shot", "missed_shots": "Missed Shot", "blocked_shots": "Blocked Shot"}


def team_event_totals(plays: DataFrame) -> DataFrame:
    """(game_id, team_id) with the number of each kind of attempt for and against the team."""
    sides = []
    for side in ("for", "against"):
        counts = (F.count_if(F.col("event") == e).alias(f"total_{n}_{side}") for n, e in KINDS.items())
        sides.append(plays.groupBy("game_id", F.col(f"team_id_{side}").alias("team_id")).agg(*counts))
    both = sides[0].join(sides[1], ["game_id", "team_id"], "outer")
    return both.na.fill(0, [c for c in both.columns if c.startswith("total_")])


def season_attempts(plays: DataFrame, goals: bool = True) -> DataFrame:
    """(team_id, cf, ca, cf_percent) over all plays; goals are attempts or not."""
    kinds = [k for k in KINDS if goals or k != "goals"]
    sums = team_event_totals(plays).groupBy("team_id").agg(*(F.sum(sum(F.col(f"total_{k}_{s}") for k in kinds)).alias(n) for s, n in (("for", "cf"), ("against", "ca"))))
    return sums.withColumn("cf_percent", F.try_divide(100.0 * F.col("cf"), F.col("cf") + F.col("ca")))


def aggregated_corsi(games: DataFrame) -> DataFrame:
    """A player's season over all teams: the main team (by time, then id), sums, and whether there were several.

    Games count once for each team, so that a game for two teams counts twice.
    """
    keys = ["season", "player_id"]
    teams = games.groupBy(*keys, "team_id").agg(*(F.sum(a).alias(b) for a, b in (("cf", "cf"), ("ca", "ca"), ("toi_es_sec", "toi"))), F.count_distinct("game_id").alias("games"))
    main = primary_row(teams, keys, [F.desc("toi"), F.asc("team_id")]).select(*keys, "team_id")
    sums = teams.groupBy(*keys).agg(F.sum("cf").alias("cf"), F.sum("ca").alias("ca"), F.sum("games").alias("game_count"), (F.count("*") > 1).alias("multi_team"), F.sum("toi").alias("toi"))
    return sums.join(main, keys).select(*keys, "team_id", "cf", "ca", "game_count", "multi_team", per60(F.col("cf"), F.col("toi")).alias("cf60"))
