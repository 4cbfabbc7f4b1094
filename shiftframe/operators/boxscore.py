"""Boxscores from events whose players stand in role columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouping import mode_by

#: What each event counts for the player of each role.
CREDITS = {
    ("GOAL", "p1"): ("goals", "shots"),
    ("GOAL", "p2"): ("assists",),
    ("GOAL", "p3"): ("assists",),
    ("SHOT", "p1"): ("shots",),
    ("HIT", "p1"): ("hits",),
    ("BLOCK", "p1"): ("blocked",),
    ("TAKE", "p1"): ("takeaways",),
    ("GIVE", "p1"): ("giveaways",),
    ("FAC", "p1"): ("faceoff_wins", "faceoff_taken"),
    ("FAC", "p2"): ("faceoff_taken",),
    ("PENL", "p1"): ("penalties_taken",),
}
COLUMNS = ("goals", "assists", "shots", "hits", "blocked", "takeaways", "giveaways", "faceoff_wins", "faceoff_taken", "penalties_taken")


def role_rows(events: DataFrame, keys: list[str], roles: list[str]) -> DataFrame:
    """(keys, role, player_raw): one row for each named player of an event."""
    return events.unpivot(keys, roles, "role", "player_raw").withColumn("player_raw", F.trim("player_raw")).where("player_raw <> ''")


def boxscore(rows: DataFrame, teams: DataFrame | None = None) -> DataFrame:
    """Counts by (season, game_id, player_id) of role rows (with event_type and role), points, and the team.

    The team is the player's most frequent one of the game in ``teams``; players without one go.
    """
    keys = ["season", "game_id", "player_id"]

    def counts(column: str):
        return F.count_if(F.lit(False) if not (pairs := [k for k, v in CREDITS.items() if column in v]) else _any(pairs)).alias(column)

    def _any(pairs):
        found = F.lit(False)
        for event, role in pairs:
            found = found | ((F.col("event_type") == event) & (F.col("role") == role))
        return found

    out = rows.groupBy(*keys).agg(*map(counts, COLUMNS)).withColumn("points", F.col("goals") + F.col("assists"))
    return out if teams is None else out.join(mode_by(teams, ["game_id", "player_id"], "team_id").drop("n"), ["game_id", "player_id"])
