"""Published tables: all or nothing, only the buckets touched, gates in the writing job."""

import os

import pytest
from pyspark.sql import functions as F

from shiftframe.operators import published, upsert
from shiftframe.operators.published import Gate


def rows_of(spark, root):
    return sorted(map(tuple, published.read(spark, root).collect()))


def files(root):
    return {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


@pytest.fixture
def root(spark, tmp_path):
    root = str(tmp_path / "t")
    published.publish(spark.createDataFrame([(k, f"v{k}") for k in range(40)], "k long, v string"), root, Gate(("k",), ("v",), 40), ["k"], 8)
    return root


def test_an_update_touches_only_its_buckets(spark, root):
    before = files(root)
    touched = published.update(spark.createDataFrame([(3, "new"), (100, "more")], "k long, v string"), root)
    assert len(touched) <= 2 and before <= files(root)
    assert rows_of(spark, root) == sorted([(k, "new" if k == 3 else f"v{k}") for k in range(40)] + [(100, "more")])
    used = {f.removeprefix("file:").removeprefix("//") for f in published.read(spark, root).inputFiles()}
    assert len({f for f in before if f in used}) >= len(before) - 2
    published.vacuum(spark, root)
    assert len(rows_of(spark, root)) == 41 and {f for f in files(root)} == used


def test_guards_and_null_fills(spark, root):
    published.update(spark.createDataFrame([(5, None)], "k long, v string"), root)
    published.update(spark.createDataFrame([(5, "filled"), (6, "not"), (70, "not")], "k long, v string"), root, lambda old, new: upsert.fill_null(old, new, ["k"], "v"))
    found = dict(rows_of(spark, root))
    assert (found[5], found[6], 70 in found) == ("filled", "v6", False)


def test_repeated_keys_publish_nothing(spark, root):
    before = rows_of(spark, root), files(root)
    twice = spark.createDataFrame([(3, "a"), (3, "b")], "k long, v string")
    with pytest.raises(ValueError, match="repeated keys: 1"):
        published.update(twice, root)
    for gate, text in ((Gate(("k",)), "repeated keys"), (Gate((), ("v",)), "null v: 1"), (Gate(rows=7), "rows: 3, not 7")):
        with pytest.raises(ValueError, match=text):
            published.publish(twice.unionByName(spark.createDataFrame([(9, None)], twice.schema)), root, gate)
    assert (rows_of(spark, root), files(root)) == before


def test_gates_take_no_further_job(spark, tmp_path):
    df, tracker, jobs = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")), spark.sparkContext.statusTracker(), {}
    for name, gate in (("bare", None), ("gated", Gate(("k",), ("v",), 100))):
        spark.sparkContext.setJobGroup(name, "")
        published.publish(df, str(tmp_path / name), gate, ["k"], 4)
        jobs[name] = len(tracker.getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs["gated"] <= jobs["bare"] + 1  # one more stage of the same query, which adaptive execution runs as a job


@pytest.mark.parametrize("step", ["_written", "_point", "half"])
def test_a_stop_at_any_step_leaves_the_old_rows(spark, root, monkeypatch, step):
    before = rows_of(spark, root)

    def stop(*args, **more):
        raise KeyboardInterrupt

    if step == "half":
        n = published.state(spark, root).number + 1
        with open(f"{root}/pointer-{n}", "w") as f:
            f.write('{"folders": {"0": ["rows')
    else:
        monkeypatch.setattr(published, step, stop)
        with pytest.raises(KeyboardInterrupt):
            published.insert(spark.createDataFrame([(1000, "x")], "k long, v string"), root)
        monkeypatch.undo()
    assert rows_of(spark, root) == before
    published.insert(spark.createDataFrame([(1000, "x")], "k long, v string"), root)
    assert rows_of(spark, root) == sorted([*before, (1000, "x")])


def test_two_writers(spark, root):
    first = published.state(spark, root)
    published.insert(spark.createDataFrame([(1000, "x")], "k long, v string"), root)
    with pytest.raises(RuntimeError, match="changed meanwhile"):
        published._point(spark, root, first, first.folders, published.read(spark, root).schema, first.keys, first.buckets)
    with pytest.raises(FileNotFoundError):
        published.read(spark, root + "-absent")


def test_a_table_may_be_rewritten_from_itself(spark, root):
    published.publish(published.read(spark, root).where("k < 5"), root)
    assert [k for k, _ in rows_of(spark, root)] == [0, 1, 2, 3, 4]
    published.insert(spark.createDataFrame([("only v",)], "v string"), root)
    assert (None, "only v") in [tuple(r) for r in published.read(spark, root).collect()]
    published.publish(published.read(spark, root).where("false"), root, keys=["k"], buckets=3)
    assert rows_of(spark, root) == [] and published.read(spark, root).columns == ["k", "v"]
