"""Secret scans whose false findings a random forest removes.

Candidates are values of six or more characters that are assigned to a name with
a key-like word in it (in quotes or not), and unbroken runs of ``RUN`` or more
key characters, dots between them included, whole texts through. The
forest judges a candidate by its length, the transitions between its characters
(changes of class, and how usual its letter pairs are in the dictionary), how
much of it dictionary words cover, the path the text came from, and the words
and signs beside it. It is trained from labelled findings, of which at most about ``SAMPLE`` for
either label are drawn by hash of row and place; the draw alone is collected, and
scores come from a model of fixed size.

Null and empty texts give no candidates; repeated rows give theirs each, and
equal candidates in equal surroundings score alike; a null
path is an empty one; texts and candidates of any length are taken whole; other columns are ignored; an empty table gives an empty
result. Without findings of both labels nothing is removed: every candidate
keeps the score 1.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, columns, small_batches, texts_of

RUN = 16
KEYWORDS = ("token", "secret", "password", "passwd", "pwd", "key", "auth", "credential", "bearer")
NAME = "A-Za-z0-9_.-"
#: A name that has one of the words, a sign, and a value, with any number of blanks between. A name is looked through from its start alone, so that long ones cost no more.
ASSIGNED = re.compile(
    rf"(?<![{NAME}])(?=[{NAME}]*?(?ai:{'|'.join(KEYWORDS)}))[{NAME}]++[\"']?[ \t]*+(?:=>|:=|[=:])[ \t]*+(?:\"(?P<double>[^\"\s]{{6,}})\"|'(?P<single>[^'\s]{{6,}})'|(?P<bare>[^\s\"',;]{{6,}}))"
)
RUNS = re.compile(rf"(?=[A-Za-z0-9+/_.-]{{{RUN}}})[A-Za-z0-9+/_-]+(?:\.[A-Za-z0-9+/_-]+)*={{0,2}}")
WORD = re.compile(r"[^\W\d_]+")
SAMPLE, TREES, DEPTH = 2000, 20, 6
FEATURES = ("length", "changes", "digits", "upper", "distinct", "entropy", "pairs", "coverage", "quoted", "assigned", "keyword", "before", "after", "path_depth", "path_kind")


@dataclass
class Dictionary:
    """Ordinary words, and the log frequency of each letter pair in them."""

    words: frozenset[str]
    pairs: dict[str, float]
    longest: int = 0

    @staticmethod
    def of(words: list[str]) -> Dictionary:
        counts = Counter(w[k : k + 2] for w in words for k in range(len(w) - 1))
        total = sum(counts.values()) or 1
        return Dictionary(frozenset(w for w in words if len(w) >= 3), {p: math.log(n / total) for p, n in counts.items()}, max(map(len, words), default=0))

    def coverage(self, text: str) -> float:
        """The share of the characters that the longest dictionary words cover, from left to right."""
        at = covered = 0
        while at < len(text):
            size = next((n for n in range(min(self.longest, len(text) - at), 2, -1) if text[at : at + n] in self.words), 0)
            covered += size
            at += size or 1
        return covered / max(1, len(text))

    def usual(self, text: str) -> float:
        """The mean log frequency of the letter pairs."""
        return sum(self.pairs.get(text[k : k + 2], -14.0) for k in range(len(text) - 1)) / max(1, len(text) - 1)


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


class Words:
    """Where the words of a text are; those beside a place are found however far off they are."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, array("q"), array("q")
        for m in WORD.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def before(self, at: int, n: int) -> list[str]:
        k = bisect_right(self.ends, at)
        return [self.text[self.starts[j] : self.ends[j]] for j in range(max(0, k - n), k)]

    def after(self, at: int) -> list[str]:
        k = bisect_left(self.starts, at)
        return [self.text[self.starts[k] : self.ends[k]]] if k < len(self.starts) else []


def _last(text: str, at: int, passed: str) -> int:
    """The place of the last character before ``at`` that is no white space and not in ``passed``; -1 without one."""
    at -= 1
    while at >= 0 and (text[at].isspace() or text[at] in passed):
        at -= 1
    return at


def features(text: str, start: int, end: int, path: str, known: Dictionary, around: Words | None = None) -> list[float]:
    value, low, around = text[start:end], text[start:end].lower(), around or Words(text)
    kinds, counts = list(map(_kind, value)), Counter(value)
    words, follows = [w.lower() for w in around.before(start, 3)], around.after(end)
    bucket = lambda w: float(zlib.crc32(w.lower().encode("utf-8", "replace")) % 64)
    quote, sign = text[max(0, start - 1) : start], _last(text, start, "'\"")
    return [
        float(len(value)),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / len(value),
        kinds.count(0) / len(value),
        kinds.count(2) / len(value),
        len(counts) / len(value),
        -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values()),
        known.usual(low),
        known.coverage(low),
        float(quote in ("'", '"') and text[end : end + 1] == quote),
        float(sign >= 0 and text[sign] in "=:"),
        float(any(k in w for w in words for k in KEYWORDS)),
        bucket(words[-1]) if words else -1.0,
        bucket(follows[0]) if follows else -1.0,
        float(path.count("/")),
        bucket(path.rpartition(".")[2].rpartition("/")[2]) if path else -1.0,
    ]


def found_in(text: str) -> list[tuple[int, int]]:
    """(start, end) of each candidate, in order; a run that overlaps an assigned value is that value's."""
    low, own = text.lower(), []
    if any(w in low for w in KEYWORDS):  # spares most texts the slower search
        own = [m.span(m.lastgroup) for m in ASSIGNED.finditer(text)]
    out, k = [], 0
    for m in RUNS.finditer(text):
        start, end = m.span()
        while k < len(own) and own[k][1] <= start:
            out.append(own[k])
            k += 1
        if end - start >= RUN and not (k < len(own) and own[k][0] < end):
            out.append((start, end))
    return out + own[k:]


def candidates(docs: DataFrame, known: Dictionary, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(id, start, end, value, features) of every candidate."""
    small_batches(docs.sparkSession)
    path = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__text"), path.alias("__path"))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column("__path").to_pylist()
            found = []
            for k, t in enumerate(texts_of(b, "__text")):
                if spans := found_in(t):
                    around = Words(t)
                    found += [(k, s, e, t[s:e], features(t, s, e, paths[k], shared.value, around)) for s, e in spans]
            at, start, end, value, x = zip(*found, strict=True) if found else [()] * 5
            arrays = [b.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(value, pa.string()), pa.array(x, pa.list_(pa.float64()))]
            yield pa.record_batch(arrays, [id_col, "start", "end", "value", "features"])

    return rows.mapInArrow(find, f"`{id_col}` {dict(rows.dtypes)[id_col]}, start int, end int, value string, features array<double>")


def dictionary(path: str) -> Dictionary:
    """The letter pieces of a public sentencepiece vocabulary, as ordinary words."""
    from .language_id import START, vocabulary

    return Dictionary.of(sorted({w for p in vocabulary(path) if (w := p.removeprefix(START))}))


def judged(found: DataFrame, label: Column, id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """``found`` with score and secret: a forest trained where ``label`` (1, 0) is not null."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    found = checkpointed(found.withColumn("__label", label.cast("double")))
    counts = {r["__label"]: r["count"] for r in found.where("__label is not null").groupBy("__label").count().collect()}
    if len(counts) < 2:
        return found.drop("__label").withColumns({"score": F.lit(1.0), "secret": F.lit(True)})
    draw = F.pmod(F.xxhash64(id_col, "value", "start", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    chance = F.when(F.col("__label") == 1, SAMPLE / counts[1.0]).otherwise(SAMPLE / counts[0.0])
    drawn = checkpointed(found.where(F.col("__label").isNotNull() & (draw < chance)).select(F.col("__label").alias("label"), array_to_vector("features").alias("x")).coalesce(4))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed, probabilityCol="p", rawPredictionCol="raw", predictionCol="hit").fit(drawn)
    scored = forest.transform(found.withColumn("x", array_to_vector("features")))
    score = vector_to_array("p")[1]
    return scored.withColumn("score", score).withColumn("secret", F.col("score") >= 0.5).drop("x", "p", "raw", "hit", "__label")


# Forms in which keys are issued. None of them is a feature of the forest.
ISSUED = (
    r"[0-9a-f]{32}", r"[0-9a-f]{40}", r"[0-9a-f]{64}", r"(AKIA|ASIA)[0-9A-Z]{16}", r"gh[pousr]_[0-9A-Za-z]{36}", r"sk_live_[0-9A-Za-z]{24,}", r"AIza[0-9A-Za-z_-]{35}",
    r"xox[abprs]-[0-9A-Za-z-]{10,}", r"eyJ[0-9A-Za-z_-]+\.eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+",
)


def issued_labels(value: Column) -> Column:
    """Labels by a finding's own form, where no reviewed ones exist: a value in the form of an issued key, with letters and
    digits, is a secret; words of letters alone, and numbers, are not; the rest is unlabelled and left to the forest."""
    key = value.rlike("^(" + "|".join(ISSUED) + ")$") & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.when(key, 1).when(value.rlike("^([A-Za-z]+|[0-9_/+.-]+)$"), 0)
