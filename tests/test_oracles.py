"""Every query that has SQL against DuckDB, on the smallest data; the others run."""

import math

import duckdb
import pytest

from shiftframe.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FITS = set(catalog.queries()) - set(catalog.oracle_sql()) - {"name_similarity", "random_sample", "hourly_counts"}  # run in test_models


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    return value if value is None or isinstance(value, bool) else str(value)


def sorted_rows(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted_rows(df.collect(), df.columns) == sorted_rows(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - FITS))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0
