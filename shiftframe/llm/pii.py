"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that reveal them.

Patterns find the protected entities (e-mail and IP addresses, card and phone
numbers). The corpus then tells how strongly a term in the documents of an entity,
at any place of their text, reveals it: with P as shares of documents, a term t discloses entity c to the degree
PMI(c; t) / IC(c) = 1 - log P(c | t) / log P(c), which is 1 where every document
with t holds c. Terms that reach ``GENERALISE`` are generalised, from ``REMOVE``
on removed. A term must be seen in ``CONTEXTS`` different surroundings: the
entity's where the term is near, and its own first ones in each document that holds the
entity, so that copies of one document prove nothing. Every occurrence of a
revealing term in the documents of its entity is a span.

Terms are whole runs of letters of any length, lower-cased one by one, outside
e-mail addresses (the only patterns with letters); near an entity are the six
terms before and the six after it, however far. Terms, entities and surroundings
are counted by 64-bit hashes.

All counts are taken over all documents. Only tables of ``BITS`` hash remainders
at most are broadcast, of candidate terms and of texts that hold entities: they
spare counting other words and shuffling other texts, and the exact
joins after them drop what merely shares a remainder.

A null text is an empty one, without spans; repeated rows each get a row and
count as documents; a term that reveals several entities of a text has the
greatest of their degrees; texts of any length are read whole, in time that grows with
their length; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, columns, small_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
NEAR = 6  # words on either side
CONTEXTS = 3
GENERALISE, REMOVE = 0.85, 0.95
BITS = 1 << 18
FLUSH = 50_000  # terms that a task counts before it sends them on
KNOWN = 100_000  # words whose hashes a task remembers

LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the longest run of local characters before it and a domain after it."""
    free = 0  # where the next match may start
    at = text.find("@")
    while at >= 0:
        run = text[free:at]
        start = at - (len(run) - len(run.rstrip(LOCAL)))
        found = DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", free)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers each, from the left, of every dotted run of numbers."""
    for run in DOTTED.finditer(text):
        parts = run[0].split(".")
        start = run.start()
        for k in range(0, len(parts) - 3, 4):
            end = start + sum(map(len, parts[k : k + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
                yield start, end
            start = end + 1


def luhn(digits: str) -> bool:
    values = list(map(int, reversed(digits)))
    return (sum(values[::2]) + sum(2 * d - 9 * (d > 4) for d in values[1::2])) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= sum(map(m[0].count, string.digits)) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then by start, in code points."""
    return [(k, s, e) for k, find in zip(KINDS, (emails, ips, cards, phones), strict=True) for s, e in find(text)]


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


class TermHashes(dict):
    """Hashes of terms, lower-cased; the last ``KNOWN`` different words are remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN:
            self.clear()
        found = self[word] = hashed(word.lower())
        return found


def places(text: str) -> list[tuple[int, int]]:
    """(start, end) of all terms, in order: runs of letters that touch no e-mail address."""
    if "@" not in text:
        return [m.span() for m in TERM.finditer(text)]
    out, at = [], 0
    for s, e in [*emails(text), (len(text), len(text))]:
        own = [m.span() for m in TERM.finditer(text, at, s)]
        if own and at and own[0][0] == at and text[at - 1].isalpha():
            own = own[1:]
        if own and own[-1][1] == s < len(text) and text[s].isalpha():
            own = own[:-1]
        out += own
        at = e
    return out


def neighbours(text: str, spans: list[tuple[str, int, int]], known: dict[str, int]) -> list[tuple[int, int, int]]:
    """(entity, surroundings, term), each once, for the ``NEAR`` terms before and after each span; all as hashes."""
    if not spans:
        return []
    terms, out = places(text), {}
    starts = [s for s, _ in terms]
    for kind, s, e in spans:
        near = terms[max(0, bisect_left(starts, s) - NEAR) : bisect_left(starts, s)]
        near += terms[bisect_left(starts, e) : bisect_left(starts, e) + NEAR]
        own = [known[text[a:z]] for a, z in near]
        entity, context = hashed(f"{kind}:{text[s:e]}"), hashed(" ".join(map(str, own)))
        out |= dict.fromkeys((entity, context, t) for t in own)
    return list(out)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


NEAR_TYPE = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("term", pa.int64())]))


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, n_email, n_ip, n_card, n_phone, base_sha256, base, plain_sha256, held, near) of every text.

    held are its different entities; plain_sha256 is of the text with the base spans replaced.
    """
    small_batches(docs.sparkSession)
    rows = columns(docs, id_col, text_col).withColumn("hash", F.xxhash64(F.col(f"`{text_col}`")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TermHashes()
        for b in batches:
            found = [(t, base_spans(t)) for t in texts_of(b, text_col)]
            joined = [_joined(s) for _, s in found]
            out = {id_col: b.column(id_col), "hash": b.column("hash")}
            out |= {f"n_{k}": pa.array([sum(x[0] == k for x in s) for _, s in found], pa.int64()) for k in KINDS}
            out["base_sha256"] = pa.array(list(map(_sha, joined)), pa.string())
            out["base"] = pa.array(joined, pa.string())
            out["plain_sha256"] = pa.array([_sha(replaced(t, s)) for t, s in found], pa.string())
            out["held"] = pa.array([sorted({hashed(f"{k}:{t[a:z]}") for k, a, z in s}) for t, s in found], pa.list_(pa.int64()))
            out["near"] = pa.array([[dict(zip(("entity", "context", "term"), x, strict=True)) for x in neighbours(t, s, known)] for t, s in found], NEAR_TYPE)
            yield pa.record_batch(out)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    near = "array<struct<entity: long, context: long, term: long>>"
    return rows.mapInArrow(find, f"`{id_col}` {dict(rows.dtypes)[id_col]}, hash long, {counts}, base_sha256 string, base string, plain_sha256 string, held array<long>, near {near}")


def document_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n_t): in how many documents each of ``terms`` (term) occurs, anywhere in the text."""
    bits = np.zeros(BITS, bool)
    bits[[r[0] for r in terms.select(F.pmod("term", F.lit(BITS)).cast("int")).distinct().collect()]] = True  # BITS rows at most
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, counts = shared.value, TermHashes(), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch({"term": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return out

        for b in batches:
            for t in texts_of(b, text_col):
                words = {t[s:e] for s, e in places(t)} if "@" in t else set(TERM.findall(t))
                counts.update({h for w in words if held[(h := known[w]) % BITS]})
            if len(counts) > FLUSH:
                yield flush()
        yield flush()

    words = columns(docs, text_col).mapInArrow(find, "term long, n long")
    return words.groupBy("term").agg(F.sum("n").alias("n_t")).join(terms, "term", "left_semi")


def texts_of_hashes(docs: DataFrame, hashes: DataFrame, text_col: str) -> DataFrame:
    """(hash, text) of the texts whose hash is in ``hashes`` (hash), and perhaps of a few more: texts are not shuffled for it."""
    bit = F.pmod("hash", F.lit(BITS)).cast("int").alias("bit")
    rows = docs.select(F.xxhash64(F.col(f"`{text_col}`")).alias("hash"), F.col(f"`{text_col}`").alias("text"))
    return rows.withColumn("bit", bit).join(F.broadcast(hashes.select(bit).distinct()), "bit", "left_semi").drop("bit")  # BITS rows at most


def whole_terms(docs: DataFrame, hashes: DataFrame, text_col: str = "text") -> DataFrame:
    """(hash, terms, contexts): all different terms of each text of ``hashes`` (hash), and the first surroundings of each, a row a text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TermHashes()
        for b in batches:
            terms, contexts = [], []
            for text in texts_of(b):
                words, first = [known[text[s:e]] for s, e in places(text)], {}
                for k, w in enumerate(words):
                    if w not in first:
                        first[w] = hashed(" ".join(map(str, words[max(0, k - NEAR) : k + NEAR + 1])))
                terms.append(list(first))
                contexts.append(list(first.values()))
            longs = pa.list_(pa.int64())
            yield pa.record_batch({"hash": b.column("hash"), "terms": pa.array(terms, longs), "contexts": pa.array(contexts, longs)})

    found = texts_of_hashes(docs, hashes, text_col).mapInArrow(find, "hash long, terms array<long>, contexts array<long>")
    return found.dropDuplicates(["hash"]).join(hashes.distinct(), "hash", "left_semi")


def term_spans(docs: DataFrame, wanted: DataFrame, remove: float = REMOVE, text_col: str = "text") -> DataFrame:
    """(hash, terms, sanitised_sha256): every occurrence (kind, start, end, degree) of the ``wanted`` (hash, term, degree) in the texts."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("degree", pa.float64())]))
    listed = wanted.groupBy("hash").agg(F.collect_list(F.struct("term", "degree")).alias("listed"))  # of one text's own terms

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TermHashes()
        for b in batches:
            found, sha = [], []
            for text, x in zip(texts_of(b), b.column("listed").to_pylist(), strict=True):
                degree = {t["term"]: t["degree"] for t in x}
                own = [(s, e, d) for s, e in places(text) if (d := degree.get(known[text[s:e]])) is not None]
                own = [("removed" if d >= remove else "name" if text[s].isupper() else "term", s, e, d) for s, e, d in own]
                found.append([dict(zip(("kind", "start", "end", "degree"), t, strict=True)) for t in own])
                sha.append(_sha(replaced(text, [*base_spans(text), *(t[:3] for t in own)])))
            yield pa.record_batch({"hash": b.column("hash"), "terms": pa.array(found, kind), "sanitised_sha256": pa.array(sha, pa.string())})

    rows = texts_of_hashes(docs, wanted, text_col).join(listed, "hash")
    schema = "hash long, terms array<struct<kind: string, start: int, end: int, degree: double>>, sanitised_sha256 string"
    return rows.mapInArrow(find, schema).dropDuplicates(["hash"])


def disclosures(docs: DataFrame, base: DataFrame, text_col: str = "text", generalise: float = GENERALISE, contexts: int = CONTEXTS) -> DataFrame:
    """(hash, term, degree) of the terms that reveal an entity of the text; ``base`` is ``marked`` of ``docs``."""
    near = base.select(F.explode("near").alias("x")).select("x.entity", "x.term", "x.context")
    texts = base.where(F.size("held") > 0).groupBy("hash", "held").agg(F.count("*").alias("copies"))
    holders = checkpointed(texts.select("hash", "copies", F.explode("held").alias("entity")))
    n_c = holders.groupBy("entity").agg(F.sum("copies").alias("n_c"), F.count("*").alias("texts"))

    def often(rows: DataFrame) -> DataFrame:
        return rows.groupBy("entity", "term", "context").count().groupBy("entity", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= contexts)

    wide = n_c.where(F.col("texts") >= contexts).select("entity").unionByName(often(near).select("entity")).distinct()
    holders = checkpointed(holders.join(wide, "entity", "left_semi"))
    words = checkpointed(whole_terms(docs, holders.select("hash"), text_col))
    zipped = F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("contexts").alias("context"))).alias("x")
    pairs = words.join(holders, "hash").select("hash", "entity", "copies", zipped).select("hash", "entity", "copies", "x.term", "x.context")
    seen = often(near.unionByName(pairs.select("entity", "term", "context"))).select("entity", "term")
    counts = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_ct"))
    counts = checkpointed(counts.join(seen, ["entity", "term"]))
    known, n_docs = document_counts(docs, counts.select("term").distinct(), text_col), base.count()
    degree = 1 - F.log(F.col("n_ct") / F.col("n_t")) / F.log(F.col("n_c") / n_docs)
    found = counts.join(known, "term").join(n_c, "entity").where(F.col("n_c") < n_docs)
    found = found.select("entity", "term", degree.alias("degree")).where(F.col("degree") >= generalise)
    return pairs.join(found, ["entity", "term"]).groupBy("hash", "term").agg(F.max("degree").alias("degree"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, contexts: int = CONTEXTS) -> DataFrame:
    """(id, hash, counts, base_sha256, base, terms, sanitised_sha256) of every text.

    terms are (kind, start, end, degree) of what reveals an entity; the last is of the text
    with entities and terms replaced, as ``sanitised`` gives it.
    """
    base = checkpointed(marked(docs, id_col, text_col))
    wanted = checkpointed(disclosures(docs, base, text_col, generalise, contexts))
    terms = term_spans(docs, wanted, remove, text_col)
    kept = [c for c in base.columns if c not in ("near", "held", "plain_sha256")]
    return base.drop("near", "held").join(terms, "hash", "left").select(*kept, "terms", F.coalesce("sanitised_sha256", "plain_sha256").alias("sanitised_sha256"))


TERMS = "array<struct<kind:string,start:int,end:int,degree:double>>"


def span_text(found: DataFrame) -> DataFrame:
    """``found`` with spans (the base spans and then the terms' as kind:start:end, joined by commas), n_generalised and n_removed."""
    terms = F.coalesce("terms", F.array().cast(TERMS))
    texts = F.transform(terms, lambda t: F.concat_ws(":", F.lit("term"), t.start, t.end))
    n = lambda use: F.size(F.filter(terms, use)).cast("long")
    spans = F.array_join(F.concat(F.array_remove(F.array(F.col("base")), ""), texts), ",")
    return found.withColumns({"spans": spans, "n_generalised": n(lambda t: t.kind != "removed"), "n_removed": n(lambda t: t.kind == "removed")})


def sanitised(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the found spans replaced: entities and terms by their kind in brackets, revealing terms above the second threshold by nothing."""
    marks = F.concat_ws(",", F.nullif("base", F.lit("")), F.transform("terms", lambda t: F.concat_ws(":", t.kind, t.start, t.end)))
    spans = found.select(F.col(f"`{id_col}`").alias("__id"), F.col("hash").alias("__hash"), marks.alias("__marks")).dropDuplicates(["__id", "__hash"])

    @F.pandas_udf("string")
    def replace(texts: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not m else replaced(t, [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in m.split(","))]) for t, m in zip(texts, marks, strict=True)], dtype=object)

    same = docs[id_col].eqNullSafe(spans["__id"]) & F.xxhash64(docs[text_col]).eqNullSafe(spans["__hash"])
    out = docs.join(spans, same, "left").withColumn(text_col, replace(docs[text_col], F.coalesce("__marks", F.lit(""))))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span (kind, start, end) replaced; of overlapping spans the first counts, of those that start together the longest."""
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda m: (m[1], -m[2])):
        if start >= at:
            out += [text[at:start], "" if kind == "removed" else f"[{kind.upper()}]"]
            at = end
    return "".join([*out, text[at:]])
