"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shiftframe.llm import decontamination, language_id, mixing, near_duplicates, pii, quality, secret_scan, sharding, simhash, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, features int, terms string, shard int"
LONG = "the quick brown fox jumps over the lazy dog " * 4000
TEXTS = [None, "", "   \n\t", "one", "²³", "a b c d e f g h", "a b c d e f g h", LONG, LONG + "x", "x" * 50_000, "mail me at bob@example.com now", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""]
ROWS = [(k, t, "en" if k % 3 else None, None if k % 4 == 0 else f"src{k % 2}", 1, 0.5, "s", 1, "t", 9) for k, t in enumerate(TEXTS)]
ROWS += [ROWS[5], ROWS[5], (None, "a b c d e f g h", "en", "src0", 1, 0.5, "s", 1, "t", 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def model(docs):
    return language_id.train(docs, public_tokenizers.path("piece_bpe_32k.model"))


def benchmark(spark):
    return spark.createDataFrame([(1, "a b c d e f g h"), (2, None), (3, ""), (4, "one"), (4, "one")], "item_id long, text string")


OPERATORS = {
    "quality": lambda s, d: quality.quality(d),
    "contaminated": lambda s, d: decontamination.contaminated(d, benchmark(s)),
    "toxicity": lambda s, d: toxicity.toxicity(d, None),
    "personal_data": lambda s, d: pii.personal_data(d),
    "secrets": lambda s, d: (lambda c: secret_scan.judged(c, secret_scan.issued_labels(F.col("value"))))(secret_scan.candidates(d, secret_scan.Dictionary.of(["the", "quick"]), path_col="source")),
    "simhash": lambda s, d: simhash.simhash_components(d),
    "tokens": lambda s, d: token_counts.token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
    "mixed": lambda s, d: mixing.corpus_mix(d),
    "shards": lambda s, d: sharding.assign_shards(d, 4),
    "deduplicated": lambda s, d: near_duplicates.deduplicated(d),
    "decontaminated": lambda s, d: decontamination.decontaminated(d, benchmark(s)),
}
ONE_ROW_EACH = ("quality", "toxicity", "personal_data", "simhash", "tokens", "mixed", "shards")


@pytest.mark.parametrize("name", OPERATORS)
def test_rows(spark, docs, name):
    found = OPERATORS[name](spark, docs).collect()
    if name in ONE_ROW_EACH:
        assert sorted(r.doc_id for r in found if r.doc_id is not None) == sorted(r[0] for r in ROWS if r[0] is not None)
        assert len(found) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, none, name):
    assert OPERATORS[name](spark, none).count() == 0


def test_language_of_odd_texts(docs, none, model):
    found = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert [found[k].lang_pred for k in (0, 1, 2, 4)] == ["und"] * 4
    assert found[3].lang_pred == found[7].lang_pred == "en"
    assert language_id.predict(none, model).count() == 0


def test_no_labels_give_und(docs, none):
    empty = language_id.train(none, public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}


def test_defined_values(spark, docs):
    tokens = {r.doc_id: r for r in OPERATORS["tokens"](spark, docs).collect()}
    assert (tokens[0].n_bytes, tokens[0].n_tokens, tokens[1].n_tokens) == (0, 0, 0)
    measures = {r.doc_id: r for r in OPERATORS["quality"](spark, docs).collect()}
    assert (measures[0].n_words, measures[0].kept, measures[2].n_words) == (0, False, 0)
    prints = {r.doc_id: r for r in OPERATORS["simhash"](spark, docs).collect()}
    assert {prints[k].component_id for k in (0, 1, 2)} == {0}
    assert prints[5].component_id == prints[6].component_id == 5
    kept = [r.doc_id for r in OPERATORS["decontaminated"](spark, docs).collect()]
    assert 5 not in kept and 6 not in kept and 3 not in kept and 7 in kept


def test_kept_columns(spark, docs):
    assert OPERATORS["deduplicated"](spark, docs).columns == docs.columns
    assert OPERATORS["decontaminated"](spark, docs).columns == docs.columns
    assert OPERATORS["shards"](spark, docs).columns == [c for c in docs.columns if c not in ("size", "shard")] + ["size", "shard", "slot"]


def test_extra_row_order_does_not_matter(docs):
    a = {(r.doc_id, r.shard, r.slot) for r in sharding.assign_shards(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), 4).collect()}
    b = {(r.doc_id, r.shard, r.slot) for r in sharding.assign_shards(docs.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy(F.desc("doc_id")), 4).collect()}
    assert a == b


def test_found_items_and_secrets(spark, docs, none):
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.item_id, round(r.similarity, 9)) for r in OPERATORS["contaminated"](spark, docs).collect())
    assert found == [(-1, 1, 1.0), (3, 4, 1.0), (3, 4, 1.0), (5, 1, 1.0), (5, 1, 1.0), (5, 1, 1.0), (6, 1, 1.0)]
    secrets = {(r.doc_id, r.value) for r in OPERATORS["secrets"](spark, docs).collect()}
    assert secrets == {(11, "04dbebab91ab85687d33eeaaf9ac699e1188f962"), (9, "x" * 50_000)}
    empty = benchmark(spark).limit(0)
    assert decontamination.contaminated(docs, empty).count() == 0 and decontamination.decontaminated(docs, empty).count() == len(ROWS)


def test_sanitised_rows(spark, docs):
    found = pii.personal_data(docs)
    clean = pii.sanitised(docs, found)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[0] is None and texts[1] == "" and texts[10] == "mail me at [EMAIL] now" and texts[7] == LONG


def test_replaced_columns_can_be_told_apart(spark, docs):
    clash = docs.withColumnRenamed("size", "n_tokens").withColumnRenamed("shard", "sampled")
    dimensions = {"source": clash["source"]}
    out = mixing.mixed(clash, {"source": {"src0": 0.5, "src1": 0.5}}, dimensions, prefix="__mix_")
    assert out.columns == [*clash.columns, "__mix_n_tokens", "__mix_cell_weight", "__mix_probability", "__mix_sampled"]
    assert {r.n_tokens for r in out.collect()} == {"s"} and out.where("__mix_probability <= 0").count() == 0


def test_copies_of_one_document_stay_together(spark, docs):
    kept = sorted(-1 if r.doc_id is None else r.doc_id for r in OPERATORS["deduplicated"](spark, docs).collect())
    assert 5 in kept and 6 not in kept and -1 not in kept and kept.count(5) == 3


def test_a_session_on_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from shiftframe.llm import common

    conf = SimpleNamespace(get=lambda name: None)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(SimpleNamespace(sparkContext=context))


def test_one_id_with_several_texts(spark):
    """Only the texts that hold an item go: rows of the same id, or of none, stay."""
    item = "alpha beta gamma delta epsilon zeta"
    rows = [(None, item), (None, "clean words"), (1, item), (1, "other words"), (2, "clean words"), (3, item), (3, None), (None, None)]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, held string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = sorted(((r.doc_id, r.text) for r in decontamination.decontaminated(docs, items).collect()), key=repr)
    assert found == sorted((r for r in rows if r[1] != item), key=repr)


HELPERS = ["__h", "__n", "__r", "__b", "__k", "__i", "__end", "__at", "__shard", "__range", "___h", "__source", "__draw", "__topic", "__lang", "__sure", "__id", "__weight", "__p", "key", "held", "value", "moved", "ratio", "part", "fp", "root", "h"]


def test_helper_columns_of_every_stage_as_input(spark):
    """Columns named like the operators' own keep their values."""
    rows = [(k, f"some plain words number {k} and then some more of them", "en", f"s{k % 2}", *range(len(HELPERS))) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in HELPERS))
    stages = {
        "shards": lambda d: sharding.assign_shards(d, 3),
        "mixed": lambda d: mixing.corpus_mix(d),
        "deduplicated": lambda d: near_duplicates.deduplicated(d),
        "decontaminated": lambda d: decontamination.decontaminated(d, benchmark(spark)),
    }
    import corpus_pipeline

    model = language_id.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    p = __import__("shiftframe.llm.common", fromlist=["apart"]).apart(docs)
    stages["language"] = lambda d: language_id.predict(d, model, keep=tuple(d.columns), out=(f"{p}lang", f"{p}sure"))
    for name, stage in stages.items():
        found = stage(docs).collect()
        assert found and all(tuple(r[c] for c in HELPERS) == tuple(range(len(HELPERS))) for r in found), name
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language_id" and p == "____"
