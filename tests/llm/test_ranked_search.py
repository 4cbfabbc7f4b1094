"""Ranked search against a plain scoring of every document."""

import math
import random
import re
from collections import Counter

import pytest

from shiftframe.llm import ranked_search

SCHEMA = "doc_id long, text string, rank string, score int, masks string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k=10):
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = set()
    for item, text in set(items):
        scored = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out |= {(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)}
    return out


def found(spark, docs, items, partitions=3, **more):
    d = spark.createDataFrame([(*r, "r", 1, "m") for r in docs], SCHEMA).repartition(partitions)
    return [tuple(r) for r in ranked_search.ranked(d, spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, score int"), **more).collect()]


def same(spark, docs, items, **more):
    rows = found(spark, docs, items, **more)
    assert len(rows) == len(set(rows)) and set(rows) == plain(docs, items)


WORDS = [f"w{k}" for k in range(400)]


def texts(n, seed):
    random.seed(seed)
    common = [WORDS[int(random.random() ** 3 * 400)] for _ in range(n * 40)]
    return [(k, " ".join(common[k * 40 : k * 40 + random.randint(0, 40)])) for k in range(n)]


@pytest.mark.parametrize("docs_in_range", [1, 7, 64, 1024])
def test_ranges_of_any_size(spark, monkeypatch, docs_in_range):
    monkeypatch.setattr(ranked_search, "RANGE_DOCS", docs_in_range)
    docs = texts(500, docs_in_range)
    same(spark, docs, [(k, docs[k * 11][1]) for k in range(30)])


def test_odd_rows_and_ties(spark):
    docs = [(1, None), (2, ""), (3, "...!?"), (4, "One TWO tWo"), (None, "one two two"), (None, "one two two"), (5, "one two two"), (5, "one two two"), (6, "Ünïted ÉTÉ été 漢字 x" + "y" * 50_000), (7, "z " * 60_000 + "rare")]
    docs += [(100 + k, "copy of one text") for k in range(700)] + texts(200, 9)
    items = [(1, "two"), (1, "two"), (1, "été É"), (2, None), (3, ""), (None, "rare one"), (4, "copy one text"), (5, "absent"), (6, "y" * 50_000), (7, "of the w1 w2 w3")]
    same(spark, docs, items)


def test_no_rows(spark):
    assert found(spark, [], [(1, "one")]) == [] and found(spark, [(1, "one")], []) == []
    assert found(spark, [(1, "one")], [(1, "one")]) == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 8 * 100)))]


def test_items_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(ranked_search, "CHUNKS", 2)
    docs = texts(300, 4)
    same(spark, docs, [(k, docs[k * 7][1]) for k in range(40)])


def test_one_range_holds_every_maximum():
    docs = texts(90, 2)
    counts = [Counter(ranked_search.terms_of(t)) for _, t in docs if t]
    ids = [i for i, t in docs if t]
    tree = ranked_search.Range(*ranked_search._range(ids, counts, 90, 2000).values())
    points = len(tree.most) - len(tree.masks)
    assert points == sum(len(c) for c in counts)
    parents = [p for p, m in enumerate(tree.masks) for _ in range(int(m).bit_count())]
    for cell, mask in enumerate(tree.masks):
        first = tree.child[cell]
        assert tree.most[cell] == max(tree.most[first : first + int(mask).bit_count()])
    assert parents == sorted(parents) and len(parents) == len(tree.most) - 1
