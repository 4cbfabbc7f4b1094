"""Prefix-wise BPE against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shiftframe.llm import bpe
from shiftframe.llm.queries import op12_bpe_coding

PATH = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"
ODD = [
    "", " ", "\n\n", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "we'll they'd I'M don't 'S ''s", "aaaaaaa aaaaaaaaaaaaaaaaaaaaa", "x" * 20_000, "É́ é ́a",
    "ΣΑΣ ΟΔΟΣ İstanbul ǅ ß ſ", "\x1c\x1d\x85  z​", "12 345 ²³ ١٢٣", "漢字かな交じり文" * 50, "👍🏽👩‍👩‍👧", "</w> <w> w</w>", "a\tb\rc\x0bd\x0ce\x00f", "<| endoftext |> <|endoftext", "word, (word) word... \"word\"",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    own = bpe.encoder(PATH)
    assert own.encode(text) == ids, repr(text[:99])
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_odd_texts(library):
    for text in ODD:
        same(library, text)


def test_random_texts(library):
    random.seed(3)
    tokens = [n.replace("</w>", "") for n in library.get_vocab()]
    for _ in range(3000):
        same(library, "".join(random.choices(tokens, k=random.randint(0, 7))))
        same(library, "".join(random.choices("aabbttheeinngr.,'!1 \n\téÀ字Σ́\x1c\x85👍", k=random.randint(0, 40))))
        same(library, "".join(chr(random.choice([random.randrange(0x20, 0x500), random.randrange(0x20, 0x3000), random.randrange(0xE000, 0x1FFFF)])) for _ in range(9)))
        same(library, "".join(random.choices("aaahmx", k=random.randint(0, 40))))


def test_full_tables_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "AT_ONCE", 100)
    own = bpe.Encoder(PATH)
    for text in [*ODD, "the quick brown fox jumps over the lazy dog\n" * 30]:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(own.known) <= 5 and len(own.pairs) <= 20


def test_every_prefix_has_the_last_token_of_its_encoding(library):
    own = bpe.encoder(PATH)
    for word in ("international", "mississippi", "unbelievably", "antidisestablishmentarianism"):
        for k in range(1, len(word) + 1):
            assert list(own.word(word[:k])) == library.encode(word[:k], add_special_tokens=False).ids


def test_query_and_odd_rows(spark, library):
    rows = [(k, t, k, "z") for k, t in enumerate([None, *ODD, "same", "same", "one two " * 40_000])] + [(None, "no id", 1, "z"), (1, "", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, ids string").repartition(3)

    def want(i, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return i, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))

    order = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in bpe.digests(docs, PATH).collect()), key=order) == sorted((want(r[0], r[1]) for r in rows), key=order)
    encoded = bpe.token_ids(docs, PATH)
    texts = {r.doc_id: r.text for r in bpe.decoded(encoded, PATH).collect()}
    assert texts[len(rows) - 4] == library.decode(library.encode("same").ids, skip_special_tokens=False) and texts[0] == ""
    assert bpe.digests(docs.limit(0), PATH).count() == 0
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert sorted(tuple(r) for r in op12_bpe_coding(spark, DATA).collect()) == sorted(want(i, t) for i, t in whole.items())


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="end-of-word"):
        bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
