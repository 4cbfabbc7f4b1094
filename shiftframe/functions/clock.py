"""Game clocks in seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def game_seconds(period: Column, seconds: Column) -> Column:
    """Seconds from the start: periods of 1200 s, and everything after the third from 3600 on."""
    return F.when(period.between(1, 3), (period - 1) * 1200 + seconds).otherwise(3600 + seconds)


def legacy_seconds(period: Column, seconds: Column) -> Column:
    """All periods of 1200 s, overtime too."""
    return (period - 1) * 1200 + seconds


def clock_parse(text: Column) -> Column:
    """Seconds of "MM:SS" or of a plain number; null for anything else."""
    parts = F.split(text, ":")
    minutes = F.get(parts, 0).try_cast("bigint") * 60 + F.get(parts, 1).try_cast("bigint")
    return F.coalesce(text.try_cast("double").cast("bigint"), F.when(F.size(parts) == 2, minutes))
