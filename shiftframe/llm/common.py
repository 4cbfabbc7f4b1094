"""What several operators share: rows as bounded Arrow batches, checkpoints, arguments' checks."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_IN_BATCH = 256
BYTES_IN_BATCH = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once, by rows and by bytes: texts may be very long.

    The session keeps the bounds, as Spark reads them when a result is computed, which may be
    after the operator has returned; a session's own lower ones are left.
    """
    for name, bound in (("maxRecordsPerBatch", ROWS_IN_BATCH), ("maxBytesPerBatch", BYTES_IN_BATCH)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= bound:
            spark.conf.set(key, bound)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only a session on one machine may do without, and gets a temporary folder.
    """
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir"):
        return found
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="checkpoints")


_written: list[list] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint()
    for held in _written:
        held.append(out)
    return out


def remove(spark: SparkSession, folder: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at the end what ``checkpointed`` wrote meanwhile: for results that have been written elsewhere by then."""
    held: list[DataFrame] = []
    _written.append(held)
    try:
        yield
    finally:
        _written.remove(held)
        for df in held:
            found = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
            if found.isDefined():
                remove(spark, found.get())


def apart(docs: DataFrame) -> str:
    """A prefix that no column of ``docs`` begins with: for helper columns, which then neither hide nor replace any."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others may have any name."""
    return docs.select(*(F.col(f"`{n}`") for n in names))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts of a batch one by one, null as an empty text."""
    for x in batch.column(column):
        yield x.as_py() or ""
