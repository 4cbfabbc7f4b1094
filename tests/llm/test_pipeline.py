"""The corpus pipeline, each stage against brute force on its own input."""

import collections
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shiftframe.llm import language_id, mixing, simhash

from .test_operators import components_of

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\W_]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows by stage name, "documents" first."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out, folder = {"documents": docs.collect()}, tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out[name] = docs.collect()
    return out


def ids(rows):
    return {r.doc_id for r in rows}


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    names = list(stages["documents"][0].asDict())
    assert all(list(stages[n][0].asDict()) == names for n in list(stages)[:-1])
    assert list(stages["sharding"][0].asDict()) == [*names, "size", "shard", "slot"]


def test_languages(spark, stages):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.train(docs.where(~language_id.in_fold(F.col("doc_id"), 4, 2)), public_tokenizers.path("piece_bpe_32k.model"))
    langs, sure = language_id.score_texts([r.text for r in stages["documents"]], model)
    want = {r.doc_id for r, lang, s in zip(stages["documents"], langs, sure, strict=True) if lang != "und" and s >= corpus_pipeline.SURE}
    assert ids(stages["language_id"]) == want


def test_one_of_each_group_stays(stages):
    rows = sorted(stages["language_id"], key=lambda r: r.doc_id)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (WORD.findall(r.text.lower()) for r in rows)]
    fps = [simhash.fingerprint(r.text.encode()) for r in rows]
    near = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    roots = components_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if near(i, j)])
    assert ids(stages["near_duplicates"]) == {rows[k].doc_id for k in set(roots)}


def test_benchmark_passages_go(spark, stages):
    items = [WORD.findall(r.text.lower()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    whole = {r.doc_id for r in stages["near_duplicates"] if any(" ".join(i) in " ".join(WORD.findall(r.text.lower())) for i in items)}
    gone = ids(stages["near_duplicates"]) - ids(stages["decontamination"])
    assert whole <= gone
    shared = lambda r, i: {tuple(i[k : k + 5]) for k in range(len(i) - 4)} & {tuple(w[k : k + 5]) for w in [WORD.findall(r.text.lower())] for k in range(len(w) - 4)}
    assert all(any(len(shared(r, i)) >= 0.5 * (len(i) - 4) for i in items) for r in stages["near_duplicates"] if r.doc_id in gone)


def test_sampling_probabilities(spark, stages):
    """Raking with plain arrays gives the same sample."""
    docs = spark.createDataFrame(stages["decontamination"])
    draw = (F.pmod(F.xxhash64("doc_id", F.lit("mix 0")), F.lit(1 << 40)) / float(1 << 40)).alias("draw")
    rows = docs.select("doc_id", "source", "lang", mixing.topic(F.col("text")).alias("topic"), mixing.tokens(F.col("text")).alias("n"), draw).collect()
    weight, n = np.ones(len(rows)), np.array([r.n for r in rows], float)
    members = []
    for d in ("source", "lang", "topic"):
        values = [r[d] for r in rows]
        shares = {v: sum(x for x, y in zip(n, values, strict=True) if y == v) / n.sum() for v in set(values)}
        scale = sum(s**corpus_pipeline.POWER for s in shares.values())
        members += [(np.array([x == v for x in values]), s**corpus_pipeline.POWER / scale, d) for v, s in sorted(shares.items())]
    for _ in range(60):
        for d in ("source", "lang", "topic"):
            now = weight.copy()
            for own, want, dim in members:
                if dim == d:
                    now[own] *= want * n.sum() / (weight * n)[own].sum()
            weight = now
    probability = weight / weight.max()
    close = {r.doc_id for r, p in zip(rows, probability, strict=True) if abs(r.draw - p) < 1e-4}
    want = {r.doc_id for r, p in zip(rows, probability, strict=True) if r.draw < p}
    assert (ids(stages["mixing"]) ^ want) <= close


def test_shards(stages):
    assert ids(stages["sharding"]) == ids(stages["mixing"])
    slots = collections.defaultdict(list)
    for r in stages["sharding"]:
        slots[r.shard].append(r.slot)
        assert r.size == len(r.text.encode()) + 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_gives_the_last_stage(spark, stages):
    assert ids(corpus_pipeline.run(spark, DATA).collect()) == ids(stages["sharding"])


def odd_folder(spark, folder, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, sampled string, n_tokens string, `odd name` int"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and columns that clash with the stages' own."""
    plain = "the quick brown fox jumps over the lazy dog and runs away"
    texts = [None, "", " \n", "²³", plain, plain, plain + " again", "the cat " * 30_000, "x" * 30_000, "alpha beta gamma delta epsilon zeta eta theta", "ein hund und eine katze gehen nach hause", None]
    rows = [(k, t, "en" if k % 3 else None, None if k % 4 == 0 else f"s{k % 2}", 1, "big", "yes", "many", 7) for k, t in enumerate(texts)]
    rows += [rows[4], (None, plain + " tonight with many others", "en", "s0", 1, "big", "yes", "many", 7)]
    found = corpus_pipeline.run(spark, odd_folder(spark, tmp_path, rows))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "sampled", "n_tokens", "odd name", "size", "shard", "slot"]
    kept = found.collect()
    assert ids(kept) <= {r[0] for r in rows} and {r.text for r in kept} <= {r[1] for r in rows}
    assert kept and not {0, 1, 2, 3, 5, 9, 11} & ids(kept) and {r.sampled for r in kept} == {"yes"}


def test_an_empty_table_gives_an_empty_result(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd_folder(spark, tmp_path, [])).count() == 0


def test_earlier_stages_and_checkpoints_are_deleted(spark, tmp_path):
    import os

    from shiftframe.llm import common

    with common.scratch(spark):
        df = common.checkpointed(spark.range(10))
        path = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
        assert df.count() == 10 and os.path.exists(path)
    assert not os.path.exists(path)
