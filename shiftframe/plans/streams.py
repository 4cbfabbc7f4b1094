"""Stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftframe.sources.tables import table
from shiftframe.streaming.replay import window_counts

from .catalog import query


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_counts(spark, sf_dir):
    """The batch form of the stream's plan; a test replays the stream itself."""
    return window_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))
