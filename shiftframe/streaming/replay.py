"""Event logs as streams: late events within a watermark, counted by window."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream over the Parquet files that match ``path``, some files a batch."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name).parquet(folder)


def window_counts(events: DataFrame, time: str = "ts", late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) by tumbling window; also for a static table."""
    held = events.withColumn(time, F.col(time).cast("timestamp"))
    held = held.withWatermark(time, late) if events.isStreaming else held
    out = held.groupBy(F.window(time, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def replayed(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Everything the stream holds now, run to its end, as a table in memory: for tests and small replays."""
    name = f"replay_{uuid.uuid4().hex}"
    run = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(name)
