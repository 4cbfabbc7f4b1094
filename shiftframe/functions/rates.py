"""Rates with guarded division: no rate raises or gives infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b, or ``empty`` (null by default) where b is 0 or null."""
    found = F.try_divide(a.cast("double"), b.cast("double"))
    return found if empty is None else F.coalesce(found, F.lit(empty))


def per60(count: Column, seconds: Column) -> Column:
    """Events an hour of ice time; null without ice time."""
    return F.when(seconds > 0, count * 3600.0 / seconds)


def percent(made: Column, against: Column, empty: float | None = None, scale: float = 100.0) -> Column:
    """made's share of both, of ``scale``; ``empty`` where there are none."""
    return F.when(made + against > 0, scale * made / (made + against)).otherwise(F.lit(empty).cast("double"))
