"""Season codes: the first year, then the next, as eight digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def season_of_year(year: Column) -> Column:
    """20182019 for 2018."""
    return (year * 10000 + year + 1).cast("long")


def season_of_end_year(year: Column) -> Column:
    """20182019 for 2019."""
    return season_of_year(year - 1)


def season_of_game(game_id: Column) -> Column:
    """The first year, as game ids carry it in front of six digits."""
    return F.floor(game_id / 1_000_000).cast("long")


def season_next(season: Column) -> Column:
    return season + 10001


def season_label(season: Column) -> Column:
    """2018-19 for 20182019."""
    return F.concat_ws("-", F.floor(season / 10000).cast("string"), F.lpad((season % 100).cast("string"), 2, "0"))
