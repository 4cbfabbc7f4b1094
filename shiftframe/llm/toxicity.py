"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own embedding (by hash) beside the embeddings of its
character trigrams and beginnings (by hash), so that unseen words are read by their letters.
Two gated recurrent layers read a window of words in both directions, attention
weights the places, and a linear layer gives the window's logit. Overlapping windows of
``WINDOW`` words, one each ``STRIDE``, are scored, the last one ending with the
text, so that any passage of WINDOW - STRIDE words or fewer lies whole in one;
the text's score is that of its most toxic window. Training treats the
labels likewise: the gradient goes through the window of the highest logit.

Labelled ids are drawn by a hash, with bounded numbers for either label, and
each gives one text (of several documents of one id, the first by hash). A text
without words (null, empty, signs only) scores 0. Without rows of
both labels every text scores 0. Repeated label rows count once, with the larger
label; null labels are not learned from; repeated documents score alike, each
its own row; ties between windows change nothing; texts of any length are scored
whole, and windows go through the network in blocks of bounded size; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, small_batches, texts_of

WORDS = re.compile(r"\w+")
WINDOW, STRIDE = 64, 32
HIDDEN, WIDTH = 8, 8
WORD_ROWS, CHAR_ROWS = 1 << 14, 1 << 15
BEGINNINGS = (4, 5, 6, 7)
POSITIVES, NEGATIVES = 900, 1500
EPOCHS, BATCH, RATE, DECAY = 6, 48, 0.01, 1e-5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Words:
    """Distinct words as rows: the word's hash, and its character grams' hashes end to end."""

    word: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Words:
        """Grams are all trigrams, blanks at both ends included, and the beginnings of ``BEGINNINGS`` letters."""
        hashed = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.int64, len(words)) % WORD_ROWS
        chars = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(length + 2) - length - 1
        owners, grams = [np.repeat(np.arange(len(words)), length)], []
        inside = np.arange(len(owners[0])) + 2 * owners[0]  # where each word's trigrams start
        grams.append(chars[inside] * 961 + chars[inside + 1] * 31 + chars[inside + 2])
        for n in BEGINNINGS:
            long = np.nonzero(length >= n)[0]
            found = np.full(len(long), n, np.int64)
            for k in range(n):
                found = found * 1000003 % (1 << 31) + chars[first[long] + k]
            owners.append(long)
            grams.append(found)
        owners, grams = np.concatenate(owners), np.concatenate(grams) % CHAR_ROWS
        sizes = np.bincount(owners, minlength=len(words))
        return Words(hashed, grams[np.argsort(owners, kind="stable")], np.cumsum(sizes) - sizes, sizes)


@dataclass
class Network:
    """Weights by name; gx and gh hold update, reset and candidate gates of the two directions."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        n = lambda *s, k=1.0: r.normal(0, k / np.sqrt(s[0]), s)
        shapes = {"word": r.normal(0, 0.1, (WORD_ROWS, WIDTH)), "char": r.normal(0, 0.3, (CHAR_ROWS, WIDTH)), "gx": n(2 * WIDTH, 2, 3 * HIDDEN), "gh": n(HIDDEN, 2, 3 * HIDDEN), "gb": np.zeros((2, 3 * HIDDEN)), "att": n(2 * HIDDEN, k=0.5), "out": n(2 * HIDDEN), "bias": np.array([-1.0])}
        return Network({k: v.astype(np.float32) for k, v in shapes.items()})

    def inputs(self, words: Words) -> np.ndarray:
        """(word, 2 * WIDTH) inputs of distinct words."""
        chars = np.add.reduceat(self.p["char"][words.grams], words.starts, 0) / np.sqrt(words.sizes)[:, None] if len(words.sizes) else np.zeros((0, WIDTH))
        return np.concatenate([self.p["word"][words.word], chars], 1).astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """(word, direction, 3 * HIDDEN): what the gates get from each distinct word."""
        return np.tensordot(x, self.p["gx"], 1) + self.p["gb"]

    def step(self, g: np.ndarray, h: np.ndarray, direction: int) -> tuple[np.ndarray, ...]:
        k = HIDDEN
        u = h @ self.p["gh"][:, direction]
        zr = _sigmoid(g[:, : 2 * k] + u[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        n = np.tanh(g[:, 2 * k :] + r * u[:, 2 * k :])
        return n + z * (h - n), z, r, n, u[:, 2 * k :]

    def states(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray, trace: list | None = None) -> np.ndarray:
        """(place, window, 2 * HIDDEN) states; ``at`` (window, place) are rows of ``gates``."""
        n, places = at.shape
        out = np.empty((places, n, 2 * HIDDEN), np.float32)
        for d, order in enumerate((range(places), range(places - 1, -1, -1))):
            h, own = np.zeros((n, HIDDEN), np.float32), gates[:, d]
            for t in order:
                new, *rest = self.step(own[at[:, t]], h, d)
                if trace is not None:
                    trace.append((d, t, h, *rest))
                m = mask[:, t, None]
                h = new if m.all() else np.where(m, new, h)
                out[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        return out

    def pooled(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window logits and the attention of each place."""
        e = np.where(mask.T, states @ self.p["att"], np.float32(-1e9))
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        return (a * (states @ self.p["out"])).sum(0) + self.p["bias"][0], a

    def logits(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self.pooled(self.states(gates, at, mask), mask)[0]

    def gradients(self, words: Words, x: np.ndarray, at: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss of the windows, and its gradients."""
        p, k, trace = self.p, HIDDEN, []
        s = self.states(self.gates(x), at, mask, trace)
        logit, a = self.pooled(s, mask)
        prob = _sigmoid(logit)
        loss = float(-np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9)))
        dl = (prob - y) / len(y)
        c = s @ p["out"]
        de = a * (c - (a * c).sum(0)) * dl
        ds = (a * dl)[:, :, None] * p["out"] + de[:, :, None] * p["att"]
        g = {n: np.zeros_like(v) for n, v in p.items() if n not in ("word", "char")}
        g["out"] += np.einsum("tb,tbh->h", a * dl, s)
        g["att"] += np.einsum("tb,tbh->h", de, s)
        g["bias"] += dl.sum()
        dgates = np.zeros((len(x), 2, 3 * k), np.float32)
        carry = [np.zeros((len(y), k), np.float32) for _ in range(2)]
        for d, t, h, z, r, n, un in reversed(trace):
            m = mask[:, t, None]
            dh = carry[d] + ds[t][:, d * k : (d + 1) * k]
            live = np.where(m, dh, 0)
            dn = live * (1 - z) * (1 - n * n)
            dz = live * (h - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            gate, rec = np.concatenate([dz, dr, dn], 1), np.concatenate([dz, dr, dn * r], 1)
            g["gh"][:, d] += h.T @ rec
            carry[d] = np.where(m, live * z, dh) + rec @ p["gh"][:, d].T
            np.add.at(dgates[:, d], at[:, t], gate)
        g["gb"] += dgates.sum(0)
        g["gx"] += np.tensordot(x.T, dgates, 1)
        dx = np.tensordot(dgates, p["gx"], ([1, 2], [1, 2]))
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], words.word, dx[:, :WIDTH])
        np.add.at(g["char"], words.grams, np.repeat(dx[:, WIDTH:] / np.sqrt(words.sizes)[:, None], words.sizes, 0))
        return loss, g


def windows(n: int) -> list[tuple[int, int]]:
    """(start, end) of each window over n words; the last ends with the text."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = [*range(0, n - WINDOW, STRIDE), n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def _laid(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of word rows as a padded matrix, and where it holds words."""
    size = np.array([len(r) for r in rows])
    mask = np.arange(size.max())[None, :] < size[:, None]
    at = np.zeros(mask.shape, np.int64)
    at[mask] = np.concatenate(rows)
    return at, mask


def _numbered(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """Distinct words, and each text as their numbers."""
    known: dict[str, int] = {}
    return known, [np.array([known.setdefault(w, len(known)) for w in WORDS.findall(t.lower())], np.int64) for t in texts]


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Network | None:
    """A network trained with Adam on whole texts, by their most toxic windows."""
    known, rows = _numbered(texts)
    kept = [k for k, r in enumerate(rows) if len(r)]
    y = np.array(labels, np.float32)
    if len({labels[k] for k in kept}) < 2:
        return None
    net, every, rng = Network.fresh(seed), list(known), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(kept)
        for batch in np.array_split(order, max(1, len(order) // BATCH)):
            step += 1
            used, back = np.unique(np.concatenate([rows[k] for k in batch]), return_inverse=True)
            words = Words.of([every[u] for u in used])
            x = net.inputs(words)
            parts, owner, at = [], [], 0
            for b, k in enumerate(batch):
                own = back[at : at + len(rows[k])]
                at += len(own)
                for s, e in windows(len(own)):
                    parts.append(own[s:e])
                    owner.append(b)
            laid, mask = _laid(parts)
            logit = net.logits(net.gates(x), laid, mask)
            best = {}
            for w, b in enumerate(owner):
                if b not in best or logit[w] > logit[best[b]]:
                    best[b] = w
            pick = [best[b] for b in range(len(batch))]
            _, g = net.gradients(words, x, laid[pick], mask[pick], y[batch])
            for n, grad in g.items():
                grad = grad + DECAY * net.p[n]
                m[n] += 0.1 * (grad - m[n])
                v[n] += 0.001 * (grad * grad - v[n])
                net.p[n] -= RATE * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
    return net


def score_texts(texts: list[str], net: Network | None, batch: int = 2048) -> np.ndarray:
    """The greatest window probability of each text, 0 without words."""
    scores = np.zeros(len(texts))
    known, rows = _numbered(texts)
    if net is None or not known:
        return scores
    every = list(known)
    gates = np.concatenate([net.gates(net.inputs(Words.of(every[s : s + 50_000]))) for s in range(0, len(every), 50_000)])
    spans = [(k, s, e) for k, r in enumerate(rows) for s, e in windows(len(r))]
    spans.sort(key=lambda x: x[2] - x[1])
    for s in range(0, len(spans), batch):
        group = spans[s : s + batch]
        at, mask = _laid([rows[k][a:z] for k, a, z in group])
        np.maximum.at(scores, [k for k, _, _ in group], _sigmoid(net.logits(gates, at, mask)).astype(float))
    return scores


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, negatives: int = NEGATIVES) -> Network | None:
    """A network from about ``positives`` and ``negatives`` labelled rows, whose texts come to the driver."""
    rows = columns(labels, id_col, label_col).toDF("id", "label").where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    counts = {r.label: r["count"] for r in rows.groupBy((F.col("label") > 0).alias("label")).count().collect()}
    draw = F.pmod(F.xxhash64("id", F.lit("toxicity sample")), F.lit(1 << 40)) / float(1 << 40)
    chance = F.when(F.col("label") > 0, positives / max(counts.get(True, 0), 1)).otherwise(negatives / max(counts.get(False, 0), 1))
    drawn = rows.where(draw < chance)  # about positives + negatives rows, so small enough to broadcast
    found = columns(docs, id_col, text_col).toDF("id", "text").join(F.broadcast(drawn), "id").groupBy("id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    found = sorted(found, key=lambda r: r.id)
    return fit([r.text or "" for r in found], [int(r.label > 0) for r in found])


def toxicity(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text."""
    small_batches(docs.sparkSession)
    rows = columns(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[pa.RecordBatch] = []

        def results() -> Iterator[pa.RecordBatch]:
            found = score_texts([t for b in group for t in texts_of(b, text_col)], shared.value)
            ids = pa.concat_arrays([b.column(id_col) for b in group])
            yield pa.record_batch({id_col: ids, "score": pa.array(found)})

        for b in batches:
            group.append(b)
            if sum(x.nbytes for x in group) >= 8 << 20:  # distinct words are looked up once in so many bytes
                yield from results()
                group = []
        if group:
            yield from results()

    found = rows.mapInArrow(score, f"`{id_col}` {dict(rows.dtypes)[id_col]}, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
