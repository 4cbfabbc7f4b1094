"""The registered queries: their contracts' columns, types and folds, and DuckDB's rows where SQL can express them."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

from shiftframe.llm import queries

from ..test_oracles import sorted_rows

DATA = "/root/testdata/sf0.001"
LONGS = lambda *names: {n: "bigint" for n in names}
COLUMNS = {
    "op1_quality_rules": LONGS("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") | {"base_failed": "boolean", "kept": "boolean"},
    "op2_decontamination": LONGS("doc_id", "item_id") | {"similarity": "double"},
    "op3_toxicity": LONGS("doc_id") | {"held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_personal_data": LONGS("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_generalised", "n_removed") | {"base_sha256": "string", "spans": "string", "sanitised_sha256": "string"},
    "op5_secret_scan": LONGS("doc_id") | {"start": "int", "end": "int", "score": "double", "secret": "boolean"},
    "op6_simhash_components": LONGS("doc_id", "component_id") | {"fingerprint": "string"},
    "op7_token_counts": LONGS("doc_id", "n_bytes", "n_tokens") | {"over_limit": "boolean"},
    "op8_mixing": LONGS("doc_id", "n_tokens") | {"cell_weight": "double", "probability": "double", "sampled": "boolean"},
    "op9_language_id": LONGS("doc_id") | {"held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_sharding": LONGS("doc_id", "size", "text_crc32", "slot") | {"law": "string", "shard": "int", "grown_shard": "int"},
}
SOME_ROWS = ("op2_decontamination", "op5_secret_scan")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def rows(spark):
    """Each query's rows, computed once."""
    found = {}

    def get(name):
        if name not in found:
            df = queries.queries()[name](spark, DATA)
            found[name] = dict(df.dtypes), df.collect()
        return found[name]

    return get


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(rows, texts, name):
    kinds, found = rows(name)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    assert set(r.doc_id for r in found) <= set(texts)
    if name not in SOME_ROWS:
        assert sorted(r.doc_id for r in found) == sorted(texts)


def test_folds(rows):
    for name, folds, fold in (("op3_toxicity", 5, 0), ("op9_language_id", 4, 2)):
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows(name)[1])


def test_values(rows, texts):
    text = lambda r: (texts[r.doc_id] or "").encode()
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows("op3_toxicity")[1])
    assert all(r.n_bytes == len(text(r)) and r.over_limit == (r.n_tokens > 512) for r in rows("op7_token_counts")[1])
    assert all(r.size == len(text(r)) + 16 and r.text_crc32 == zlib.crc32(text(r)) and r.law == "bytes" and r.grown_shard is None for r in rows("op10_sharding")[1])
    assert all(not (r.base_failed and r.kept) for r in rows("op1_quality_rules")[1])
    assert all(hashlib.sha256((texts[r.doc_id] or "")[r.start : r.end].encode()).hexdigest() == r.value_sha256 for r in rows("op5_secret_scan")[1])
    assert all(r.sanitised_sha256 == hashlib.sha256(text(r)).hexdigest() for r in rows("op4_personal_data")[1] if not r.spans)


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components_from_the_definition(rows, texts):
    prints = {d: plain_fingerprint(t or "") for d, t in texts.items()}
    group = {d: d for d in texts}
    for _ in range(len(texts)):
        now = {d: min(group[e] for e in texts if (prints[d] ^ prints[e]).bit_count() <= 3) for d in texts}
        if now == group:
            break
        group = now
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in rows("op6_simhash_components")[1]} == {d: (prints[d], group[d]) for d in texts}


def test_token_counts_are_the_librarys(rows, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(r.n_tokens == len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids) for r in rows("op7_token_counts")[1])


def test_kept_is_the_posterior_of_plain_estimation(spark):
    """The same estimation over single texts, in arrays, gives the same qualities."""
    from shiftframe.llm import quality

    found = quality.quality(spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    names = list(quality.rules())
    votes = np.array([[r[n] for n in names] for r in found])
    on_good, on_bad, prior = np.tile(quality.ON_GOOD, (len(names), 1)), np.tile(quality.ON_BAD, (len(names), 1)), quality.PRIOR
    column = np.array([quality.VOTES.index(v) for v in votes.ravel()]).reshape(votes.shape)
    each = np.arange(len(names))

    def posterior():
        odds = math.log(prior / (1 - prior)) + np.log(on_good[each, column] / on_bad[each, column]).sum(1)
        return 1 / (1 + np.exp(-odds))

    for _ in range(quality.ROUNDS):
        good, before = posterior(), prior
        for share, weight in ((on_good, good), (on_bad, 1 - good)):
            for k in range(len(names)):
                sums = np.array([weight[column[:, k] == v].sum() for v in range(3)]) + quality.SMOOTH * len(found)
                share[k] = sums / sums.sum()
        prior = min(0.999, max(0.001, good.mean()))
        if abs(prior - before) < quality.SETTLED:
            break
    assert np.allclose(posterior(), [r.quality for r in found], atol=1e-6)
    assert all(r.kept == (not r.base_failed and q >= 0.5) for r, q in zip(found, posterior(), strict=True) if abs(q - 0.5) > 1e-6)


def test_toxicity_of_held_out_texts(spark):
    folder = "/root/testdata/sf0.1"  # the smaller tables have too few toxic texts to learn from
    found = queries.op3_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    toxic = [r.score for r in found if r.toxic]
    clean = [r.score for r in found if r.toxic == 0]
    area = np.mean([[(a > b) + (a == b) / 2 for b in clean] for a in toxic])
    assert toxic and clean and area > 0.9 and sum(r.predicted == r.toxic for r in found) >= 0.9 * len(found)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    df = queries.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted_rows(df.collect(), df.columns) == sorted_rows(want.fetchall(), names)
