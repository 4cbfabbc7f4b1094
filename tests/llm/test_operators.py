"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shiftframe.llm import components, decontamination, language_id, mixing, near_duplicates, pii, quality, secret_scan, sharding, simhash, token_counts, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").persist()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def components_of(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(k) for k in range(n)]


def test_connected_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(200)] + [(rng.randrange(300, 600), rng.randrange(300, 600)) for _ in range(200)]
    want = components_of(600, links)
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: want[x] for p in links for x in p if p[0] != p[1]}


def test_simhash_against_brute_force(docs, texts):
    ids = sorted(texts)
    fps = np.array([simhash.fingerprint(texts[k].encode()) for k in ids], np.uint64)
    pairs = [(i, i + 1 + int(j)) for i in range(len(ids)) for j in np.nonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3)[0]]
    want = dict(zip(ids, (ids[k] for k in components_of(len(ids), pairs)), strict=True))
    assert {r.doc_id: r.component_id for r in simhash.simhash_components(docs).collect()} == want


def test_simhash_links_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 60))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(12, rng.integers(0, 4), replace=False)) for _ in range(120)} | {int(x) for x in rng.integers(0, 1 << 60, 50)})
    pairs = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = components_of(len(fps), pairs)
    links = [(fps.index(r.a), fps.index(r.b)) for r in simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    assert set(links) | {b[::-1] for b in links} <= {x for p in pairs for x in (p, p[::-1])}
    assert components_of(len(fps), links) == want


def test_native_hash_agrees(spark):
    text = "Some Words of Ünïcode text here"
    words = text.encode().lower().split()
    import xxhash

    mine = np.uint64(xxhash.xxh64_intdigest(b" ".join(words[:3]), 42)).view(np.int64)
    assert spark.range(1).select(F.xxhash64(F.lit(b" ".join(words[:3]).decode()))).first()[0] == mine


def test_token_counts_are_the_librarys(docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    found = {r.doc_id: r for r in token_counts.token_counts(docs, path, batch_bytes=5000, piece_chars=300).collect()}
    assert all(found[k].n_tokens == len(whole.encode(t, add_special_tokens=False)) and found[k].n_bytes == len(t.encode()) for k, t in texts.items())


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "x  y   z", "it's we'll 12 345 été", "日本語 テキスト です", "tabs\tand\nlines \n mixed", "a  b c", "<|endoftext|>" * 5 + " tail"])
def test_pieces_keep_the_count(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    for size in (1, 2, 5):
        assert "".join(token_counts.pieces(text * 9, size)) == text * 9
        assert token_counts.lengths([text * 9], path, 20, size) == [len(Tokenizer.from_file(path).encode(text * 9, add_special_tokens=False))]


def test_quality_measures(docs, texts):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for r in quality.quality(docs).collect():
        t = texts[r.doc_id]
        w = word.findall(t)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        times = collections.Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if times[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if word.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and (not r.kept or not r.base_failed)


def test_quality_agrees_with_labels(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = quality.quality(docs).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == bool(r.label) for r in rows) >= 0.97 * len(rows)


def test_decontamination_against_brute_force(spark, docs, texts):
    word = re.compile(r"[^\W_]+")
    items = [(r.item_id, word.findall(r.text.lower())) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bags = {i: collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in items}
    df = collections.Counter(s for b in bags.values() for s in b)
    weight = lambda s: 1 + math.log(len(items) / df.get(s, 1))
    want = set()
    for d, t in texts.items():
        w = word.findall(t.lower())
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for i, bag in bags.items():
            if not bag.keys() & set(grams):
                continue
            n = sum(bag.values())
            for start in range(max(1, len(grams) - n + 1)):
                own = collections.Counter(grams[start : start + n])
                low, high = own & bag, own | bag
                if sum(weight(s) * c for s, c in low.items()) >= 0.8 * sum(weight(s) * c for s, c in high.items()):
                    want.add((d, i))
                    break
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert found == want and want


def test_block_index_misses_nothing():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 1 << 63, 30, np.uint64) for _ in range(50)]
    items = decontamination.Items.of(5, list(range(50)), words)
    near = items.prints.copy()
    for k in range(50):
        for b in rng.choice(64, decontamination.RADIUS, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    window, item, distance = decontamination.near_items(near, items)
    want = {(i, j) for i in range(50) for j in range(50) if (int(near[i]) ^ int(items.prints[j])).bit_count() <= decontamination.RADIUS}
    assert set(zip(window.tolist(), item.tolist(), strict=True)) == want and distance.max() <= decontamination.RADIUS


def test_items_with_one_edited_word_are_found():
    rng = np.random.default_rng(3)
    words = [rng.integers(1, 1 << 63, 50, np.uint64) for _ in range(500)]
    items = decontamination.Items.of(5, list(range(500)), words)
    found = 0
    for k, own in enumerate(words):
        edited = own.copy()
        edited[rng.integers(4, 46)] = 0  # 41 of 51 shingles stay: 0.804
        text = np.concatenate([rng.integers(1, 1 << 63, 20, np.uint64), edited, rng.integers(1, 1 << 63, 20, np.uint64)])
        found += [m[0] for m in decontamination.matches(text, items, 0.8)] == [k]
    assert found == 500


def test_blocks_of_items_do_not_change_the_result(spark, monkeypatch):
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common = [fresh(12) for _ in range(3)]
    items = [common[k % 3] + fresh(20) + common[(k + k // 3) % 3] for k in range(12)]
    rows = [(k, " ".join(fresh(9) + w[: len(w) - k % 5] + fresh(9))) for k, w in enumerate(items)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = lambda: sorted((r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontamination.contaminated(docs, benchmark).collect())
    whole = found()
    assert len(whole) >= 6
    for name, size in (("ITEMS", 1), ("ITEMS", 2), ("WORDS_IN_BLOCK", 100), ("STRETCH", 7), ("PIECE", 30)):
        with monkeypatch.context() as m:
            m.setattr(decontamination, name, size)
            assert found() == whole


def test_stretches_and_pieces_change_nothing(monkeypatch):
    rng = np.random.default_rng(11)
    words = [rng.integers(1, 1 << 63, 9, np.uint64) for _ in range(3)]
    own = [rng.integers(1, 1 << 63, n, np.uint64) for n in (12, 30, 45)]
    items = decontamination.Items.of(5, [0, 1, 2], own)
    text = np.concatenate([words[0], own[0], own[1][:-2], words[1], own[2], own[2], words[2], own[1]])
    whole = decontamination.matches(text, items, 0.8)
    assert sorted(m[0] for m in whole) == [0, 1, 2]
    for size in (1, 5, 40):
        monkeypatch.setattr(decontamination, "STRETCH", size)
        assert decontamination.matches(text, items, 0.8) == whole


def test_a_long_text_of_benchmark_passages_takes_little_memory():
    import time
    import tracemalloc

    rng = random.Random(3)
    passages = [" ".join(f"word{rng.randrange(5000)}" for _ in range(60)) for _ in range(5)]
    known = {}
    items = decontamination.Items.of(5, list(range(5)), [decontamination.word_hashes(decontamination.words_of(t), known) for t in passages])
    text = " ".join(passages[k % 5] + f" x{k} " for k in range(20_000))  # about 10 MB
    tracemalloc.start()
    began = time.time()
    words = decontamination.hashed_text(text, lambda ws: decontamination.word_hashes(ws, known))
    assert sorted(m[0] for m in decontamination.matches(words, items, 0.8)) == list(range(5))
    assert tracemalloc.get_traced_memory()[1] < 300 << 20 and time.time() - began < 120
    tracemalloc.stop()


def test_toxicity_gradients():
    net = toxicity.Network.fresh(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = toxicity.Words.of(["alpha", "beta", "gamma", "délta", "x"])
    at, mask = np.array([[0, 1, 2, 3], [4, 2, 0, 0]]), np.array([[True] * 4, [True, True, False, False]])
    y = np.array([1.0, 0.0])
    toxicity_loss = lambda: net.gradients(words, net.inputs(words).astype(float), at, mask, y)[0]
    _, g = net.gradients(words, net.inputs(words), at, mask, y)
    rng = np.random.default_rng(0)
    for name in ("gx", "gh", "gb", "att", "out", "bias"):
        flat = net.p[name].reshape(-1)
        for k in rng.choice(flat.size, min(3, flat.size), replace=False):
            keep, step = flat[k], 1e-3
            flat[k] = keep + step
            up = toxicity_loss()
            flat[k] = keep - step
            down = toxicity_loss()
            flat[k] = keep
            assert abs((up - down) / (2 * step) - g[name].reshape(-1)[k]) < 2e-3


def test_toxicity_learns_held_out_texts():
    rng = random.Random(0)
    plain = ["ba", "be", "bi", "bo", "bu", "da", "de", "di", "do", "du"]
    word = lambda: "".join(rng.choice(plain) for _ in range(rng.randrange(1, 4)))

    def text(bad):
        words = [word() for _ in range(rng.randrange(20, 200))]
        for _ in range(6 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zork", "gruzzle"]) + rng.choice(["", "s", "ing"]))
        return " ".join(words)

    rows = [(text(k % 3 == 0), int(k % 3 == 0)) for k in range(400)]
    net = toxicity.fit([t for t, _ in rows[:300]], [y for _, y in rows[:300]])
    scores = toxicity.score_texts([t for t, _ in rows[300:]] + [""], net)
    assert np.mean((scores[:-1] >= 0.5) == np.array([y for _, y in rows[300:]], bool)) >= 0.95
    assert scores[-1] == 0 and toxicity.fit(["a b"], [1]) is None


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 200, 1000):
        spans = toxicity.windows(n)
        assert {k for s, e in spans for k in range(s, e)} == set(range(n))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
ODD = ["a@b.c_d@e.f x", "@a.b c@d", "a@b@c.d", "..@x.y.z-", "1.2.3.4.5.6.7.8", "300.1.2.3.4", "1.2.3.4.5", "0001.002.3.4 " + "9" * 5000 + ".1.1.1", "x" * 3000 + "@", "a@b..c", "é@b.co"]


@pytest.mark.parametrize("text", ODD)
def test_patterns_match_leftmost(text):
    assert list(pii.emails(text)) == [m.span() for m in EMAIL.finditer(text)]
    assert list(pii.ips(text)) == [m.span() for m in IP.finditer(text) if all(len(p) < 100 and int(p) <= 255 for p in m[0].split("."))]


def test_random_patterns():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("ab1.2@-_ .") for _ in range(rng.randrange(30)))
        assert list(pii.emails(text)) == [m.span() for m in EMAIL.finditer(text)]
        assert list(pii.ips(text)) == [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]


def test_revealing_terms(spark):
    rng = random.Random(1)
    filler = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "sed", "quis"]) for _ in range(8))
    rows = [(k, f"{filler()} Zebulon bob@example.com {filler()}") for k in range(6)]
    rows += [(k, f"{filler()} {filler()}") for k in range(6, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.span_text(pii.personal_data(docs)).persist()
    by_id = {r.doc_id: r for r in found.collect()}
    assert all(by_id[k].spans.startswith("email:") and len(by_id[k].terms) == 1 for k in range(6))
    assert all(by_id[k].terms is None and by_id[k].spans == "" for k in range(6, 200))
    term = by_id[0].terms[0]
    assert rows[0][1][term.start : term.end] == "Zebulon"
    clean = {r.doc_id: r.text for r in pii.sanitised(docs, found).collect()}
    assert "Zebulon" not in clean[0] and "[EMAIL]" in clean[0] and clean[7] == rows[7][1]


def test_terms_far_from_their_entity_reveal_it(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "sed", "quis"]) for _ in range(n))
    rows = [(k, f"{filler(8)} Zebulon {filler(30)} bob@example.com {filler(3 if k % 2 else 20)} Qwertz {filler(9)} zebulon") for k in range(6)]
    rows += [(6, f"{filler(9)} Zebra zebra zebra bob@example.com")] + [(k, filler(16)) for k in range(7, 200)]
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    masked = {r.doc_id: [rows[r.doc_id][1][t.start : t.end] for t in r.terms or []] for r in found}
    assert masked == {k: ["Zebulon", "Qwertz", "zebulon"] if k < 6 else [] for k in range(200)}


CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(d * 2, 10)) if k % 2 else d for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    """The patterns of the contract, one regular expression each."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = {"email": (EMAIL, lambda m: True), "ip": (IP, lambda m: all(int(p) <= 255 for p in m[0].split("."))), "card": (CARD, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), "phone": (PHONE, lambda m: 8 <= len(digits(m)) <= 15)}
    return [(k, *m.span()) for k, (pattern, good) in kinds.items() for m in pattern.finditer(text) if good(m)]


def revealed(rows, least=0.85, contexts=3):
    """Term spans of each row, straight from the definition."""
    terms_of, held, near, seen = {}, {}, collections.defaultdict(set), collections.defaultdict(set)
    for i, text in rows:
        spans = base_spans(text)
        emails = [(s, e) for k, s, e in spans if k == "email"]
        terms = [m for m in re.finditer(r"[^\W\d_]+", "".join("\0" if any(s <= k < e for s, e in emails) else c for k, c in enumerate(text)))]
        terms_of[i] = [(m.start(), m.end(), text[m.start() : m.end()].lower()) for m in terms]
        held[i] = {(k, text[s:e]) for k, s, e in spans}
        for k, s, e in spans:
            own = [t[2] for t in terms_of[i] if t[1] <= s][-6:] + [t[2] for t in terms_of[i] if t[0] >= e][:6]
            for t in own:
                near[(k, text[s:e]), t].add(tuple(own))
    for i, _ in rows:
        words = [t[2] for t in terms_of[i]]
        for c in held[i]:
            for t in set(words):
                k = words.index(t)
                seen[c, t].add(tuple(words[max(0, k - 6) : k + 7]))
    n, n_t = len(rows), collections.Counter(t for i, _ in rows for t in {x[2] for x in terms_of[i]})
    n_c = collections.Counter(c for i, _ in rows for c in held[i])
    out = {i: [] for i, _ in rows}
    for i, _ in rows:
        for s, e, t in terms_of[i]:
            for c in held[i]:
                n_ct = sum(c in held[j] and t in {x[2] for x in terms_of[j]} for j, _ in rows)
                if len(near[c, t] | seen[c, t]) >= contexts and n_c[c] < n and 1 - math.log(n_ct / n_t[t]) / math.log(n_c[c] / n) >= least:
                    out[i].append((s, e))
                    break
    return out


def test_base_spans_of_the_corpus(spark, texts):
    from shiftframe.llm import queries

    digest = lambda spans: hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
    for r in queries.op4_personal_data(spark, DATA).collect():
        spans = base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == digest(spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in spans) for k in ("email", "ip", "card", "phone")]
        assert r.spans.startswith(",".join(f"{k}:{s}:{e}" for k, s, e in spans))


def test_terms_against_brute_force(spark):
    rng = random.Random(4)
    words = ["lorem", "ipsum", "Dolor", "Amet", "sed", "Öl", "a", "İstanbulX", "Donaudampfschifffahrtselektrizitaetenhauptbetriebswerk"]
    entities = ["bob@example.com", "eve@mail.example.org", "10.1.2.3", "+44 20 7946 0958"]
    rows = []
    for k in range(60):
        own = [rng.choice(words[:7]) for _ in range(rng.randrange(4, 30))]
        if k < 24:
            own.insert(rng.randrange(len(own)), entities[k % 4])
            own += [words[7 + k % 2]] if k % 4 < 2 else []
            rng.shuffle(own)
        rows.append((k, rng.choice([" ", " / ", " (" + "-" * 160 + ") "]).join(own)))
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = revealed(rows)
    assert {r.doc_id: [(t.start, t.end) for t in r.terms or []] for r in found} == want and sum(map(len, want.values())) >= 8


def test_near_terms_are_words_however_far_and_long(spark):
    known = pii.TermHashes()
    for text in ("alpha (" + "-" * 160 + ") bob@example.com", "Donaudampfschifffahrtselektrizitaetenhaupt bob@example.com x"):
        spans = base_spans(text)
        terms = {t for _, _, t in pii.neighbours(text, spans, known)}
        assert terms == {pii.hashed(w.lower()) for w in re.findall("[A-Za-z]{5,}|x$", text.replace("bob@example.com", ""))}
    assert pii.places("éabc@x.com é") == [(11, 12)]


def test_a_mail_log_takes_linear_time():
    import time

    text = "from bob@example.com to eve@example.org subject " * 20_000  # about 1 MB
    began = time.time()
    spans = pii.base_spans(text)
    assert len(spans) == 40_000 and len(pii.neighbours(text, spans, pii.TermHashes())) < 100
    assert time.time() - began < 4


def test_secret_candidates():
    text = "password = \"hunter2secret\"; api_key: AbC123xyz jwt eyJhbGciOi.eyJzdWIiOiIx.abc-def_g, thequickbrownfoxjumps. abcdefghijklmno. auth_token='s p' secret=" + "k" * 5000
    assert [text[s:e] for s, e in secret_scan.found_in(text)] == ["hunter2secret", "AbC123xyz", "eyJhbGciOi.eyJzdWIiOiIx.abc-def_g", "thequickbrownfoxjumps", "k" * 5000]


def test_secret_scan(spark, docs, texts):
    """Precision and recall on findings of documents that the forest has not seen."""
    found = secret_scan.candidates(docs, secret_scan.dictionary(public_tokenizers.path("piece_bpe_32k.model")), path_col="source").persist()
    label = secret_scan.issued_labels(F.col("value"))
    held = language_id.in_fold(F.col("doc_id"), 4, 1)
    rows = secret_scan.judged(found, F.when(~held, label)).withColumn("held", held).withColumn("label", label).collect()
    assert len(rows) == sum(len(secret_scan.found_in(t or "")) for t in texts.values())
    assert all(texts[r.doc_id][r.start : r.end] == r.value for r in rows)
    judged = [r for r in rows if r.held and r.label is not None]
    hit = sum(r.secret and r.label == 1 for r in judged)
    assert hit >= 0.95 * sum(r.label for r in judged) > 0 and hit >= 0.95 * sum(r.secret for r in judged)
    planted = [r for r in rows if re.fullmatch("[0-9a-f]{40}", r.value)]
    assert planted and all(r.secret for r in planted)


def test_mixing_reaches_the_targets(docs):
    found = mixing.corpus_mix(docs).persist()
    total = found.agg(F.sum("n_tokens")).first()[0]
    own = {r[0] for r in found.select("source").distinct().collect()}
    targets = mixing.TARGETS | {"source": {v: 1 / len(own) for v in own}}
    for d, column in (("source", F.col("source")), ("lang", F.col("lang")), ("topic", mixing.topic(F.col("text")))):
        shares = {r[0]: r[1] for r in found.groupBy(column.alias("v")).agg(F.sum(F.col("n_tokens") * F.col("cell_weight")) / total).collect()}
        want = {v: targets[d][v] for v in shares if v in targets[d]}
        scale = sum(want.values())
        assert all(abs(shares[v] - w / scale) < 1e-3 for v, w in want.items())
    assert found.agg(F.max("probability")).first()[0] == pytest.approx(1)
    assert {r.doc_id for r in found.where("sampled").collect()} == {r.doc_id for r in mixing.corpus_mix(docs.repartition(7)).where("sampled").collect()}


def test_unlisted_and_null_values_are_sampled(spark):
    """Values without a target keep their own share of the tokens."""
    rng = random.Random(8)
    rows = [(k, "a b c d", f"src{k % 20}" if k % 3 else ["new", None][k % 2], rng.choice(["en", "fr", "de", "es", "it", None])) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    found = mixing.corpus_mix(docs, {"source": {f"src{k}": 0.05 for k in range(20)}} | mixing.TARGETS).persist()
    assert found.agg(F.min("probability")).first()[0] > 0
    total = found.agg(F.sum("n_tokens")).first()[0]
    other = ~F.coalesce(F.col("source").startswith("src"), F.lit(False))
    mixed = found.groupBy(other.alias("other"), "source").agg(F.sum(F.col("n_tokens") * F.col("cell_weight")) / total, F.count_if("sampled")).collect()
    assert sum(r[2] for r in mixed if r.other) == pytest.approx(1 / 3, abs=1e-3) and all(r[3] > 0 for r in mixed)
    assert all(r[2] == pytest.approx(0.05 * 2 / 3, abs=1e-3) for r in mixed if not r.other)
    assert mixing.corpus_mix(docs).agg(F.min("probability")).first()[0] > 0
    cells = mixing.cells_of(docs, {"source": docs["source"]})
    named = {r.value: r.share for r in mixing.alike(cells, "source").collect()}
    assert set(named) == {"new", *(f"src{k}" for k in range(20))} and len(set(named.values())) == 1
    own = {r.value: r.share for r in mixing.shares(cells, "source").collect()}
    assert own["new"] == pytest.approx(1 / 6) and sum(own.values()) == pytest.approx(sum(named.values()))


@pytest.mark.parametrize("few", [1, 1 << 18])
def test_thousands_of_small_sources_are_raked(spark, monkeypatch, few):
    """2000 sources, one with a third of all rows: each gets its equal share, by broadcast cells or by salted ones."""
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", few)
    monkeypatch.setattr(mixing, "FEW_CELLS", few)
    rows = [(k, "a b c" + " d" * (k % 3), f"s{k % 2000}" if k % 3 else "hot", "fr" if k // 2000 % 2 else "en") for k in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    dimensions = {"source": docs["source"], "lang": docs["lang"]}
    cells = mixing.cells_of(docs, dimensions)
    found = mixing.mixed(docs, {"source": mixing.alike(cells, "source"), "lang": {"en": 0.5, "fr": 0.5}}, dimensions, cells)
    assert found.count() == 9000 and found.columns == [*docs.columns, "n_tokens", "cell_weight", "probability", "sampled"]
    total = found.agg(F.sum("n_tokens")).first()[0]
    share = F.sum(F.col("n_tokens") * F.col("cell_weight")) / total
    by_source = [r[1] for r in found.groupBy("source").agg(share).collect()]
    assert len(by_source) == 2001 and max(by_source) < 1.05 / len(by_source) and min(by_source) > 0.95 / len(by_source)
    assert {r[0]: round(r[1], 3) for r in found.groupBy("lang").agg(share).collect()} == {"en": 0.5, "fr": 0.5}


def test_probabilities_against_plain_raking(docs):
    rows = mixing.corpus_mix(docs).select("*", mixing.topic(F.col("text")).alias("topic")).collect()
    n, weight, members = np.array([r.n_tokens for r in rows], float), np.ones(len(rows)), []
    for d in ("source", "lang", "topic"):
        values = [r[d] for r in rows]
        want = mixing.TARGETS[d] if d in mixing.TARGETS else dict.fromkeys(set(values), 1.0)
        scale = sum(want[v] for v in set(values))
        members += [(d, np.array([x == v for x in values]), want[v] / scale) for v in sorted(set(values))]
    for _ in range(60):
        for d in ("source", "lang", "topic"):
            now = weight.copy()
            for dim, own, want in members:
                if dim == d:
                    now[own] *= want * n.sum() / (weight * n)[own].sum()
            weight = now
    assert np.allclose(weight / weight.max(), [r.probability for r in rows], atol=1e-4)


def lattice_brute(word, known, unknown):
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        p = known.get(word[:n], unknown if n == 1 else 0.0)
        total += p * lattice_brute(word[n:], known, unknown) if p else 0.0
    return total


def test_forward_sums_all_segmentations():
    pieces = {"a": 0, "b": 1, "ab": 2, "aba": 3}
    prob = np.array([0.2, 0.3, 0.1, 0.15, 1e-9])
    words = ["abab", "aab", "b", "abax"]
    got = language_id.Lattice.of(words, pieces).likelihood(prob)
    known = {p: prob[k] for p, k in pieces.items()}
    assert got == pytest.approx([lattice_brute(w, known, 1e-9) for w in words])
    counts = language_id.Lattice.of(["ab"], pieces).expected(prob, np.array([1.0]))
    assert counts[2] == pytest.approx(0.1 / 0.16) and counts[0] == counts[1] == pytest.approx(0.06 / 0.16)


def test_words_in_parts_and_every_piece():
    pieces = language_id.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert any(len(p) > 12 for p in pieces) and language_id.START in pieces and language_id.START + "the" in pieces
    assert language_id.parts("x" * 50) == ["▁" + "x" * 24, "x" * 24, "xx"] and language_id.parts("ab") == ["▁ab"]


def test_text_scores_against_brute_force(spark):
    rows = [(k, t, g) for k, (t, g) in enumerate([("the cat sat on the mat", "en"), ("der hund und die katze", "de"), ("the dog and a cat", "en"), ("die maus und der hund", "de")])]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), public_tokenizers.path("piece_bpe_32k.model"))
    for text in ("the hund", "die cat und " + "maus" * 15, "katze"):
        total = model.prior.copy()
        for word in text.split():
            for part in language_id.parts(word):
                for g, prob in enumerate(model.prob):
                    ahead = [1.0] + [0.0] * len(part)
                    for end in range(1, len(part) + 1):
                        for start in range(end):
                            p = model.piece_id.get(part[start:end], len(prob) - 1 if end == start + 1 else None)
                            ahead[end] += 0 if p is None else ahead[start] * prob[p]
                    total[g] += math.log(ahead[-1])
        name, score = language_id.score_texts(iter([text]), model)
        assert name[0] == model.languages[int(total.argmax())] and score[0] == pytest.approx(1 / np.exp(total - total.max()).sum())


def test_language_of_held_out_texts(docs):
    held = language_id.in_fold(F.col("doc_id"), 4, 2)
    model = language_id.train(docs.where(~held), public_tokenizers.path("piece_bpe_32k.model"))
    rows = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_ranges_by_bytes_change_no_shard(spark, docs, monkeypatch):
    found = lambda: sorted((r.doc_id, r.shard, r.slot) for r in sharding.assign_shards(docs.select("doc_id", "text"), 8).collect())
    whole = found()
    monkeypatch.setattr(sharding, "RANGE_BYTES", 4000)
    assert found() == whole


def test_a_run_of_equal_texts_may_cross_shards(spark):
    rows = [(k, "same text " * 10 if k % 3 else f"own {k}") for k in range(900)]
    found = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    sizes = collections.Counter()
    for r in found:
        sizes[r.shard] += r.size
    assert len({r.shard for r in found if r.text.startswith("same")}) > 5 and max(sizes.values()) - min(sizes.values()) <= 2 * 116


def test_shards_are_even_and_gapless(spark, docs):
    rows = sharding.assign_shards(docs, 8).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(set)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].add(r.slot)
    largest = max(r.size for r in rows)
    assert all(abs(s - sum(sizes.values()) / 8) <= largest for s in sizes.values())
    assert all(s == set(range(len(s))) for s in slots.values()) and len(rows) == docs.count()


def test_one_text_fills_many_shards(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id"))).otherwise("same text everywhere").alias("text"))
    counts = {r.shard: r.n for r in sharding.assign_shards(docs, 10).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert max(counts.values()) - min(counts.values()) <= 80


def test_near_duplicates_stage(docs, texts):
    kept = {r.doc_id for r in near_duplicates.deduplicated(docs).collect()}
    ids = sorted(texts)
    words = {k: re.findall(r"[^\W_]+", texts[k].lower()) for k in ids}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in words.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    pairs = [(i, j) for i in range(len(ids)) for j in range(i + 1, len(ids)) if min(len(sets[ids[i]]), len(sets[ids[j]])) >= 0.8 * max(len(sets[ids[i]]), len(sets[ids[j]])) and alike(ids[i], ids[j])]
    want = {ids[k] for k in set(components_of(len(ids), pairs))}
    assert len(kept ^ want) <= 0.001 * len(ids)


def near_copies(rng, words, changed):
    words = list(words)
    for k in rng.sample(range(len(words)), changed):
        words[k] = f"w{rng.randrange(10**9)}"
    return words


@pytest.mark.parametrize("form", ["star", "chain"])
def test_edited_copies_leave_one(spark, monkeypatch, form):
    """Copies of one original, and copies of copies: the first text is all that stays."""
    monkeypatch.setattr(near_duplicates, "CHUNK", 256)
    rng = random.Random(4)
    rows = [[f"w{rng.randrange(10**9)}" for _ in range(300)]]
    for _ in range(2000):
        rows.append(near_copies(rng, rows[0] if form == "star" else rows[max(0, len(rows) - rng.randrange(1, 4))], 6))
    sets = [{tuple(w[i : i + 5]) for i in range(296)} for w in rows]
    orders = np.random.default_rng(5).integers(0, 1 << 63, near_duplicates.VIEWS, np.uint64) * np.uint64(2) + np.uint64(1)
    views = np.array([near_duplicates.view_prints(near_duplicates.shingle_set(" ".join(w), {}), orders) for w in rows])
    pairs = [(i, j) for j in range(len(rows)) for i in ([0] if form == "star" else range(max(0, j - 8), j)) if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert sum((views[i] == views[j]).any() for i, j in pairs) >= 0.997 * len(pairs)
    want = set(components_of(len(rows), [(i, j) for i, j in pairs if (views[i] == views[j]).any()]))
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string").repartition(8)
    found = {r.doc_id for r in near_duplicates.deduplicated(docs).collect()}
    assert found == want and len(want) <= 0.003 * len(rows)


def test_group_links_join_what_brute_force_joins():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, 40, np.uint64)) for _ in range(30)]
    for _ in range(150):
        own = sets[rng.integers(len(sets))]
        sets.append(np.unique(np.concatenate([own[rng.random(len(own)) > 0.08], rng.integers(0, 1 << 63, 3, np.uint64)])))
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if near_duplicates.similarity(sets[i], sets[j]) >= 0.8]
    n, zero = len(sets), np.zeros(len(sets), int)
    links = near_duplicates.group_links(sets, np.arange(n), zero, zero, np.zeros((n, 0), np.int64), 0, 0.8)
    assert set(links) <= set(pairs) and components_of(n, links) == components_of(n, pairs) and len(links) < len(pairs)


def test_far_names_blanks_and_neighbours_of_secrets():
    """Key names of any length, any blanks around the sign, neighbours however far; and no quadratic search."""
    import time

    value = "Zq81xkPd00"
    for name in ("token", "my." + "x" * 60 + "_token" + "y" * 60, "API_KEY"):
        for gap in ("", " " * 10, "\t \t" * 9):
            text = f"words {name}{gap}={gap}{value} end"
            assert [text[s:e] for s, e in secret_scan.found_in(text) if text[s:e] == value] == [value], (name, gap)
    text = "secretword " + "1" * 100 + " , " + "a1" * 10 + " , " + "2" * 100 + " next"
    s = text.index("a1")
    known = secret_scan.Dictionary.of(["extraordinarily", "the"])
    row = dict(zip(secret_scan.FEATURES, secret_scan.features(text, s, s + 20, "", known), strict=True))
    assert row["keyword"] == 1 and row["before"] >= 0 and row["after"] >= 0
    assert known.coverage("extraordinarily") == 1
    began = time.time()
    for hard in ("token" * 40_000, "token " * 40_000, "token=" * 40_000, "key" + " " * 200_000, "a.b-" * 50_000):
        secret_scan.found_in(hard)
    assert time.time() - began < 20


def plain_runs(text):
    """Runs of 16 and more, and assigned values of six and more, found character by character."""
    run, name = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"), set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")
    assigned, at = [], 0
    while at < len(text):
        if text[at] not in name or at and text[at - 1] in name:
            at += 1
            continue
        end = at
        while end < len(text) and text[end] in name:
            end += 1
        here, k = None, end
        if any(w in text[at:end].lower() for w in secret_scan.KEYWORDS):
            k += text[k : k + 1] in ("'", '"') and k < len(text)
            while text[k : k + 1] in (" ", "\t") and k < len(text):
                k += 1
            sign = next((x for x in ("=>", ":=", "=", ":") if text.startswith(x, k)), "")
            for sign in [x for x in ("=>", ":=", "=", ":") if text.startswith(x, k)]:
                j = k + len(sign)
                while text[j : j + 1] in (" ", "\t") and j < len(text):
                    j += 1
                quote = text[j : j + 1]
                if quote in ("'", '"') and quote:
                    e = j + 1
                    while e < len(text) and text[e] != quote and not text[e].isspace():
                        e += 1
                    if text[e : e + 1] == quote and e - j - 1 >= 6:
                        here = (j + 1, e, e + 1)
                elif quote:
                    e = j
                    while e < len(text) and not text[e].isspace() and text[e] not in "\"',;":
                        e += 1
                    if e - j >= 6:
                        here = (j, e, e)
                if here:
                    break
        if here:
            assigned.append(here[:2])
            at = here[2]
        else:
            at = end
    runs, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and (text[end] in run or text[end] == "." and end > at and text[end + 1 : end + 2] and text[end + 1] in run):
            end += 1
        if end > at:
            pad = 0
            while pad < 2 and text[end + pad : end + pad + 1] == "=":
                pad += 1
            if end + pad - at >= 16 and (end - at >= 16):
                runs.append((at, end + pad))
            at = end + pad
        else:
            at += 1
    return sorted(assigned + [r for r in runs if not any(s < r[1] and r[0] < e for s, e in assigned)])


def test_candidates_against_a_plain_finder():
    rng = random.Random(21)
    parts = ["token", "key", "=", ":=", "=>", ": ", "'", '"', " ", "\n", "abcdef", "0123456789abcdef0", "a/b+c_d-e", ".", ",", "Secret_", "xyz" * 7, "é", "\t"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert sorted(secret_scan.found_in(text)) == plain_runs(text), repr(text)


def plain_toxicity(net, words):
    """One window's probability, word by word and direction by direction, from the definition."""
    import zlib

    p, k, sigmoid = {n: v.astype(float) for n, v in net.p.items()}, toxicity.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    inputs = []
    for w in words:
        chars = [ord(c) for c in f" {w} "]
        grams = [(a * 961 + b * 31 + c) % toxicity.CHAR_ROWS for a, b, c in zip(chars, chars[1:], chars[2:])]
        for n in toxicity.BEGINNINGS:
            if len(w) >= n:
                found = n
                for c in chars[1 : n + 1]:
                    found = found * 1000003 % (1 << 31) + c
                grams.append(found % toxicity.CHAR_ROWS)
        inputs.append(np.concatenate([p["word"][zlib.crc32(w.encode()) % toxicity.WORD_ROWS], sum(p["char"][g] for g in grams) / math.sqrt(len(grams))]))
    states = np.zeros((len(words), 2 * k))
    for d, order in enumerate((range(len(words)), range(len(words) - 1, -1, -1))):
        h = np.zeros(k)
        for t in order:
            gx, gh = inputs[t] @ p["gx"][:, d] + p["gb"][d], h @ p["gh"][:, d]
            z, r = sigmoid(gx[:k] + gh[:k]), sigmoid(gx[k : 2 * k] + gh[k : 2 * k])
            h = (1 - z) * np.tanh(gx[2 * k :] + r * gh[2 * k :]) + z * h
            states[t, d * k : (d + 1) * k] = h
    attention = np.exp(states @ p["att"])
    return sigmoid((attention / attention.sum()) @ (states @ p["out"]) + p["bias"][0])


def test_toxicity_against_a_plain_loop_over_windows(texts):
    net = toxicity.Network.fresh(3)
    some = ["", "?!", "one", "Émile ²³ zzz", *[t for t in list(texts.values())[:12] if t], "a b c d e f g " * 30]
    found = toxicity.score_texts(some, net, batch=7)
    for text, score in zip(some, found, strict=True):
        words = re.findall(r"\w+", text.lower())
        starts = [0] if len(words) <= toxicity.WINDOW else [*range(0, len(words) - toxicity.WINDOW, toxicity.STRIDE), len(words) - toxicity.WINDOW]
        assert score == pytest.approx(max((plain_toxicity(net, words[s : s + toxicity.WINDOW]) for s in starts), default=0) if words else 0, abs=1e-4)
