"""Forward lines by ice time, and how they match up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP = ["season", "team_id"]


def assign_lines(players: DataFrame, depth: int = 12, size: int = 3) -> DataFrame:
    """The ``depth`` players of most time of a team, with rank and line of ``size``."""
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("toi_es_sec"), "player_id"))
    return players.withColumn("rank", rank).where(F.col("rank") <= depth).withColumn("line", F.expr(f"int((rank - 1) div {size} + 1)"))


def line_totals(players: DataFrame, size: int = 3) -> DataFrame:
    """Complete lines' sums and how many of each role they hold (c0, c1, c2)."""
    rows = assign_lines(players, size=size).groupBy(*GROUP, "line").agg(
        F.count("*").alias("n"), F.sum("cf").alias("cf"), F.sum("ca").alias("ca"), F.sum("toi_es_sec").alias("toi"), *(F.count_if(F.col("cluster") == k).alias(f"c{k}") for k in range(3))
    )
    return rows.where(F.col("n") == size).drop("n")


def line_matchup(lines: DataFrame) -> DataFrame:
    """(season, game_id, team_id): a team's lines' attempts and time in a game, beside those of all other teams of the game.

    ``lines`` has a row for each line of a game, with cf, ca and toi; teams alone in their game have no row.
    """
    sums = lines.groupBy("season", "game_id", "team_id").agg(*(F.sum(c).alias(f"team_{c}") for c in ("cf", "ca", "toi")))
    game = Window.partitionBy("season", "game_id")
    both = sums.withColumns({f"opp_{c}": F.sum(f"team_{c}").over(game) - F.col(f"team_{c}") for c in ("cf", "ca", "toi")} | {"__teams": F.count("*").over(game)})
    share = lambda side: F.try_divide(F.col(f"{side}_cf"), F.col(f"{side}_cf") + F.col(f"{side}_ca"))
    return both.where("__teams > 1").drop("__teams").withColumns({"team_cf_share": share("team"), "opp_cf_share": share("opp")})
