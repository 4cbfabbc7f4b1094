"""Language ID by unigram pieces, all segmentations of a word summed.

The pieces are those of a fixed public vocabulary. For each language, piece
probabilities are estimated by expectation-maximisation on the labelled words:
a forward and a backward pass sum over every segmentation of each word, and
the expected piece counts are the next estimate. A text's log-likelihood is the
sum over its words of the log of the forward sum; the language of the greatest
posterior is predicted, and the posterior is the score.

Words are runs of letters, lower-cased, and begin with the vocabulary's word-start
mark; all its pieces of letters, marked or not, take part, of whatever length. Words of more than ``WORD`` letters
are scored in parts, of which the first has the mark. Characters outside the vocabulary get the fixed
probability ``UNKNOWN``. The whole text is always scored.

A null text, or one without letters, is ``und`` with score 0; so is every text
when no row is labelled. Ties go to the language first in order. Repeated rows
count as often as they come, rows of null language are not learned from, and
other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, small_batches, texts_of

WORD = 24
START = "▁"  # the vocabulary's mark of a word's beginning
UNKNOWN = 1e-9
LETTERS = re.compile(r"[^\W\d_]+")
SAMPLE_CHARS = 300_000
STEPS = 4
CACHE = 250_000


def words_of(text: str) -> list[str]:
    """The words of a text; none if it has no letter (the pattern also takes signs such as superscripts)."""
    words = LETTERS.findall(text.lower())
    return words if any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w) else []


def vocabulary(path: str) -> list[str]:
    """The pieces of letters of a sentencepiece file, lower-cased, with their word-start marks; the mark alone is one."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(k).lower() for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
    return sorted({n for n in names if n == START or n.removeprefix(START).isalpha()})


def parts(word: str) -> list[str]:
    """A word as it is scored: its beginning marked, in parts of at most ``WORD`` letters."""
    return [START + word[:WORD], *(word[k : k + WORD] for k in range(WORD, len(word), WORD))]


def with_prefixes(piece_id: dict[str, int]) -> dict[str, int]:
    """``piece_id`` and, as -1, all beginnings of pieces that are none."""
    return {p[:n]: -1 for p in piece_id for n in range(1, len(p))} | piece_id


@dataclass
class Lattice:
    """All segmentations of some words: for each end, the edges (word, start, piece) that reach it."""

    n: int
    ends: np.ndarray  # each word's length
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # by end, from 1

    @staticmethod
    def of(words: list[str], piece_id: dict[str, int], prefixes: dict[str, int] | None = None) -> Lattice:
        """The lattice of words, or parts, as they are; ``prefixes`` is ``with_prefixes`` of the pieces, if it is known."""
        longest = max(map(len, words), default=0)
        found: list[tuple[list[int], list[int], list[int]]] = [([], [], []) for _ in range(longest + 1)]
        get, unknown = (with_prefixes(piece_id) if prefixes is None else prefixes).get, len(piece_id)
        for k, w in enumerate(words):
            for start in range(len(w)):
                for end in range(start + 1, len(w) + 1):
                    p = get(w[start:end], -2)
                    if p < 0 and end == start + 1:
                        found[end][0].append(k)
                        found[end][1].append(start)
                        found[end][2].append(unknown)
                    elif p >= 0:
                        found[end][0].append(k)
                        found[end][1].append(start)
                        found[end][2].append(p)
                    if p == -2:  # no piece begins so
                        break
        return Lattice(len(words), np.array([len(w) for w in words], int), [tuple(np.array(x, np.int64) for x in f) for f in found])

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """(word, place) sums over the segmentations of each word's beginning."""
        sums = np.zeros((self.n, len(self.steps)))
        sums[:, 0] = 1
        for end, (owner, start, piece) in enumerate(self.steps[1:], 1):
            sums[:, end] = np.bincount(owner, sums[owner, start] * prob[piece], self.n)
        return sums

    def likelihood(self, prob: np.ndarray) -> np.ndarray:
        return self.forward(prob)[np.arange(self.n), self.ends]

    def expected(self, prob: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected piece counts when each word occurs so many times."""
        ahead = self.forward(prob)
        behind = np.zeros_like(ahead)
        behind[np.arange(self.n), self.ends] = times / ahead[np.arange(self.n), self.ends]
        counts = np.zeros(len(prob))
        for end in range(len(self.steps) - 1, 0, -1):
            owner, start, piece = self.steps[end]
            flow = behind[owner, end] * prob[piece]
            counts += np.bincount(piece, flow * ahead[owner, start], len(prob))
            np.add.at(behind, (owner, start), flow)
        return counts


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    piece_id: dict[str, int]
    prob: np.ndarray  # (language, piece), the last piece being the unknown one

    @cached_property
    def prefixes(self) -> dict[str, int]:
        return with_prefixes(self.piece_id)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(word, language) log-likelihoods."""
        owned = [(k, p) for k, w in enumerate(words) for p in parts(w)]
        lattice = Lattice.of([p for _, p in owned], self.piece_id, self.prefixes)
        scores = np.log(np.stack([lattice.likelihood(p) for p in self.prob], 1))
        if len(owned) == len(words):
            return scores
        out = np.zeros((len(words), len(self.languages)))
        np.add.at(out, [k for k, _ in owned], scores)
        return out


def in_fold(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``fold``; false for null ids."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(labelled: DataFrame, vocabulary_path: str, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from labelled rows, of which each language gives about ``sample_chars`` characters.

    A row is drawn by a hash of its id, with the same chance for all rows of a
    language; only counts of the drawn rows' words come to the driver.
    """
    rows = columns(labelled, id_col, text_col, lang_col).toDF("id", "text", "lang").where("lang is not null and text is not null")
    sizes = {r.lang: (r.chars, r.n) for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n")).collect()}
    pieces = vocabulary(vocabulary_path)
    languages = sorted(k for k, (chars, _) in sizes.items() if chars)
    if not languages:
        return Model([], np.zeros(0), {}, np.zeros((0, 1)))
    chance = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, sample_chars / sizes[k][0]))))
    draw = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.where(draw < chance[F.col("lang")])
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    counted = drawn.select("lang", words.alias("w")).groupBy("lang", "w").count().orderBy("lang", "w").collect()

    piece_id, prob = {p: k for k, p in enumerate(pieces)}, []
    prefixes = with_prefixes(piece_id)
    for lang in languages:
        times = Counter()
        for g, w, n in counted:
            if g == lang:
                for p in parts(w):
                    times[p] += n
        lattice = Lattice.of(list(times), piece_id, prefixes)
        p = np.full(len(pieces) + 1, 1 / (len(pieces) + 1))
        p[-1] = UNKNOWN
        for _ in range(STEPS):
            found = lattice.expected(p, np.array(list(times.values()), float))[:-1] + 1e-3
            p[:-1] = found / found.sum()
        prob.append(p)
    prior = np.array([sizes[k][1] for k in languages], float)
    return Model(languages, np.log(prior / prior.sum()), piece_id, np.stack(prob))


def score_texts(texts: Iterator[str], model: Model) -> tuple[list[str], list[float]]:
    """The predicted language and its posterior for each text."""
    cache: dict[str, int] = {}
    table = np.zeros((0, len(model.languages)))
    names, scores = [], []
    waiting: list[list[str]] = []

    def settle() -> None:
        nonlocal table
        if len(cache) > CACHE:
            cache.clear()
            table = table[:0]
        if model.languages and (new := [w for w in dict.fromkeys(w for ws in waiting for w in ws) if w not in cache]):
            cache.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
            table = np.concatenate([table, model.word_scores(new)])
        for ws in waiting:
            if not ws or not model.languages:
                names.append("und")
                scores.append(0.0)
                continue
            total = model.prior + table[np.fromiter(map(cache.__getitem__, ws), np.int64, len(ws))].sum(0)
            best = int(total.argmax())
            names.append(model.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        waiting.clear()

    held = 0
    for text in texts:
        waiting.append(words_of(text))
        held += len(waiting[-1])
        if held > 200_000:
            settle()
            held = 0
    settle()
    return names, scores


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``id``, the ``keep`` columns, and the language and its posterior (named by ``out``) of every whole text."""
    small_batches(docs.sparkSession)
    names = [id_col, *(c for c in keep if c != id_col)]
    rows = columns(docs, *dict.fromkeys([*names, text_col]))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(rows.dtypes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (langs, scores) in scored(batches, shared.value, text_col):
            yield pa.record_batch({c: batch.column(c) for c in names} | {out[0]: pa.array(langs, pa.string()), out[1]: pa.array(scores, pa.float64())})

    fields = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return rows.mapInArrow(score, f"{fields}, {out[0]} string, {out[1]} double")


def scored(batches: Iterator[pa.RecordBatch], model: Model, text_col: str) -> Iterator[tuple[pa.RecordBatch, tuple[list[str], list[float]]]]:
    """Each batch with its texts' results; some batches are scored together, as their words repeat."""
    group: list[pa.RecordBatch] = []
    rows = size = 0

    def results() -> Iterator[tuple[pa.RecordBatch, tuple[list[str], list[float]]]]:
        names, scores = score_texts((t for b in group for t in texts_of(b, text_col)), model)
        at = 0
        for b in group:
            yield b, (names[at : at + b.num_rows], scores[at : at + b.num_rows])
            at += b.num_rows

    for b in batches:
        group.append(b)
        rows += b.num_rows
        size += b.nbytes
        if rows >= 8192 or size >= 24 << 20:
            yield from results()
            group, rows, size = [], 0, 0
    if group:
        yield from results()
