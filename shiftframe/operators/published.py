"""Tables that change as a whole or not at all: folders of rows that are never rewritten, and one pointer written last.

``root/rows/<id>`` holds what one write made; ``root/pointer-<n>`` names the folders that are the table from then
on. A pointer is created only if it is absent, so that of two writers of one number the second fails. Readers take the
greatest pointer that is whole. A write that stops at any step leaves the table as it was.

A keyed table lies in buckets by a hash of its keys, a folder each; an update reads and writes only
the buckets that its rows fall in, and the next pointer names the others' folders again. Gates
are counted by the job that writes: rows, nulls, and keys that repeat.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .upsert import upserted

BUCKET = "bucket"


@dataclass(frozen=True)
class Gate:
    """What must hold of written rows: unique keys, columns without nulls, and their number, where given."""

    keys: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    rows: int | None = None


@dataclass(frozen=True)
class State:
    """What a pointer says: the folders by bucket ("": not bucketed), the columns, the keys and the number of buckets."""

    number: int
    folders: dict[str, list[str]]
    schema: str
    keys: list[str]
    buckets: int


def _files(spark: SparkSession, root: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _files(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []


def _read_text(spark: SparkSession, file: str) -> str:
    fs, path = _files(spark, file)
    stream = fs.open(path(file))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def state(spark: SparkSession, root: str) -> State | None:
    """The table's latest whole pointer; None without one."""
    numbers = sorted((int(n.removeprefix("pointer-")) for n in _names(spark, root) if n.startswith("pointer-")), reverse=True)
    for n in numbers:
        try:
            return State(n, **json.loads(_read_text(spark, f"{root}/pointer-{n}")))
        except (ValueError, TypeError):  # its writer stopped
            continue
    return None


def _point(spark: SparkSession, root: str, before: State | None, folders: dict[str, list[str]], schema: StructType, keys: list[str], buckets: int) -> None:
    taken = [int(n.removeprefix("pointer-")) for n in _names(spark, root) if n.startswith("pointer-")]
    if before is not None and (now := state(spark, root)) is not None and now.number != before.number:
        raise RuntimeError(f"{root} has changed meanwhile")
    fs, path = _files(spark, root)
    stream = fs.create(path(f"{root}/pointer-{max(taken, default=0) + 1}"), False)  # fails if it exists
    stream.write(json.dumps({"folders": folders, "schema": schema.json(), "keys": keys, "buckets": buckets}).encode())
    stream.close()


def _read(spark: SparkSession, root: str, found: State, only: set[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(found.schema))
    folders = [f"{root}/{f}" for b, fs in found.folders.items() if only is None or b in only for f in fs]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The table's rows as its pointer has them now."""
    found = state(spark, root)
    if found is None:
        raise FileNotFoundError(f"no table at {root}")
    return _read(spark, root, found)


def _gated(df: DataFrame, gate: Gate | None) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` that counts while it is written, and what raises afterwards if the counts fail the gate."""
    if gate is None:
        return df, lambda: None
    seen, counts = Observation(), [F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"null {c}") for c in gate.not_null)]
    if gate.keys:
        again = F.row_number().over(Window.partitionBy(*gate.keys).orderBy(*gate.keys)) > 1
        df = df.withColumn("__again", again)
        counts.append(F.count_if("__again").alias("repeated keys"))
    watched = df.observe(seen, *counts)
    watched = watched.drop("__again") if gate.keys else watched

    def judge() -> None:
        found = seen.get
        bad = {k: v for k, v in found.items() if k != "rows" and v}
        if gate.rows is not None and found["rows"] != gate.rows:
            bad["rows"] = f"{found['rows']}, not {gate.rows}"
        if bad:
            raise ValueError(", ".join(f"{k}: {v}" for k, v in bad.items()))

    return watched, judge


def _written(df: DataFrame, root: str, gate: Gate | None, keys: list[str], buckets: int) -> dict[str, list[str]]:
    """The folders by bucket of the rows of ``df``, which are removed again if they fail the gate."""
    spark, folder = df.sparkSession, f"rows/{uuid.uuid4().hex}"
    rows, judge = _gated(df, gate)
    try:
        if buckets:
            placed = rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
            placed.repartition(BUCKET, *keys).write.partitionBy(BUCKET).parquet(f"{root}/{folder}")
        else:
            rows.write.parquet(f"{root}/{folder}")
        judge()
    except BaseException:
        fs, path = _files(spark, root)
        fs.delete(path(f"{root}/{folder}"), True)
        raise
    if not buckets:
        return {"": [folder]}
    return {n.partition("=")[2]: [f"{folder}/{n}"] for n in _names(spark, f"{root}/{folder}") if n.startswith(f"{BUCKET}=")}


def publish(df: DataFrame, root: str, gate: Gate | None = None, keys: list[str] | None = None, buckets: int = 0) -> None:
    """The rows of ``df``, which may read the table, become the table; with ``keys`` in so many buckets."""
    before = state(df.sparkSession, root)
    folders = _written(df, root, gate, keys or [], buckets)
    _point(df.sparkSession, root, before, folders, df.schema, keys or [], buckets)


def insert(df: DataFrame, root: str, gate: Gate | None = None) -> None:
    """The rows of ``df`` come to the table's, all or none; columns go by name, and the table's others are null."""
    spark, before = df.sparkSession, state(df.sparkSession, root)
    if before is None:
        publish(df, root, gate)
        return
    schema = StructType.fromJson(json.loads(before.schema))
    rows = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    new = _written(rows, root, gate, before.keys, before.buckets)
    folders = {b: before.folders.get(b, []) + new.get(b, []) for b in {**before.folders, **new}}
    _point(spark, root, before, folders, schema, before.keys, before.buckets)


def update(new: DataFrame, root: str, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, gate: Gate | None = None) -> set[str]:
    """The table's rows and the new ones merged, by default as ``upserted``, in the buckets of the new rows; gives these buckets.

    ``merge`` gets the old rows of those buckets and the new rows, and may keep, change or add rows of their keys.
    """
    spark, before = new.sparkSession, state(new.sparkSession, root)
    if before is None or not before.buckets:
        raise ValueError(f"{root} is no keyed table")
    bucket = F.pmod(F.xxhash64(*(F.col(k) for k in before.keys)), F.lit(before.buckets)).cast("int")
    touched = {str(r[0]) for r in new.select(bucket.alias("b")).distinct().collect()}  # at most as many as buckets
    old = _read(spark, root, before, touched)
    merged = (merge or (lambda a, b: upserted(a, b, before.keys)))(old, new).select(*old.columns)
    written = _written(merged, root, gate or Gate(tuple(before.keys)), before.keys, before.buckets)
    folders = {b: f for b, f in before.folders.items() if b not in touched} | written
    _point(spark, root, before, folders, old.schema, before.keys, before.buckets)
    return touched


def vacuum(spark: SparkSession, root: str) -> None:
    """Deletes the folders and pointers that the latest pointer does not need; only when no reader is at older ones."""
    found = state(spark, root)
    if found is None:
        return
    fs, path = _files(spark, root)
    needed = {f.split("/")[1] for fs_ in found.folders.values() for f in fs_}
    for n in _names(spark, root):
        if n.startswith("pointer-") and int(n.removeprefix("pointer-")) < found.number:
            fs.delete(path(f"{root}/{n}"), False)
    for n in _names(spark, f"{root}/rows"):
        if n not in needed:
            fs.delete(path(f"{root}/rows/{n}"), True)
        elif n in needed:
            for b in _names(spark, f"{root}/rows/{n}"):
                if b.startswith(f"{BUCKET}=") and not any(f"rows/{n}/{b}" in fs_ for fs_ in found.folders.values()):
                    fs.delete(path(f"{root}/rows/{n}/{b}"), True)
