"""Catalog lookups: tables by pattern, existence checks, required columns."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def season_tables(spark: SparkSession, prefix: str) -> dict[int, str]:
    """Tables named prefix_YYYYYYYY, by season."""
    found = (re.fullmatch(rf"{re.escape(prefix)}_(\d{{8}})", t.name) for t in spark.catalog.listTables(pattern=f"{prefix}_*"))
    return {int(m[1]): m[0] for m in found if m}


def missing_relations(spark: SparkSession, wanted: dict[str, list[str]]) -> list[str]:
    """Tables, and table.column names, that are wanted and not there."""
    out = []
    for name, columns in wanted.items():
        if not spark.catalog.tableExists(name):
            out.append(name)
        else:
            own = spark.table(name).columns
            out += [f"{name}.{c}" for c in columns if c not in own]
    return out


def ensure_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")


def add_columns(spark: SparkSession, table: str, wanted: dict[str, str]) -> list[str]:
    """Adds the columns (name to type) that the table lacks, and says which."""
    own = spark.table(table).columns
    new = {c: kind for c, kind in wanted.items() if c not in own}
    if new:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'`{c}` {kind}' for c, kind in new.items())})")
    return list(new)


#: What ``validate`` returns.
VALID, NO_TABLE, NO_COLUMN, NO_ROWS = 0, 2, 3, 4


def validate(spark: SparkSession, wanted: dict[str, list[str]], smoke: dict[str, str] | None = None) -> tuple[int, str]:
    """A code and what it is about: tables and columns that must be there, then tables that must have rows under a condition."""
    for name, columns in wanted.items():
        for found in missing_relations(spark, {name: columns}):
            return (NO_TABLE if found == name else NO_COLUMN), found
    for name, condition in (smoke or {}).items():
        if spark.table(name).where(condition).isEmpty():
            return NO_ROWS, name
    return VALID, ""
