"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

Texts and items are runs of letters and digits, lower-cased. Every window of an
item's number of words, at any place of a text, has a weighted SimHash of its
five-word shingles. Four blocks of 16 bits index the items' fingerprints: one
within ``RADIUS`` bits agrees to RADIUS // 4 bits in one block at least, and the
index lists each item under every such block value, so that all items within
the radius are found. Similar windows may lie beyond the radius: candidates are
therefore also all windows whose weight of shingles shared with an item permits
the similarity. Candidates are verified by weighted Jaccard
similarity of the shingle multisets; shingles that many items share weigh less.

Windows that share no shingle with any item have similarity 0 to all of them;
their fingerprints are not computed, nor those of texts that hold too few of
every item's shingles for the similarity, which loses nothing.

Items of fewer than five words are one shingle of their own length; items
without words match nothing. Null texts have no words. Repeated rows and items
each give their own rows; null ids stay null; other columns are ignored; empty
tables give an empty result. Of an item's windows in a text the nearest counts,
of equally near ones the first. Texts of any length are read whole, their words
in pieces and their windows in stretches of ``STRETCH`` places, so that memory
grows by some bytes a word.

The benchmark is taken in blocks of at most ``ITEMS`` items and ``WORDS_IN_BLOCK``
words, each small enough to broadcast. Shingles are counted over the whole
benchmark first, so that weights do not depend on the blocks; with each go the
counts of shingles that two items or more share, 16 bytes each. All others weigh
what an unseen shingle does. With one block a text is read once. With several, a
first pass keeps the texts that share a shingle with any item, by a bitmap of
``BITS`` hash remainders, a bound that does not grow; only these are read for each block.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, columns, small_batches, texts_of

WORDS = re.compile(r"[^\W_]+")
SHINGLE, SIMILAR = 5, 0.8
RADIUS, BLOCKS = 15, 4
ITEMS, WORDS_IN_BLOCK = 2000, 1_000_000
KNOWN = 100_000  # words whose hashes a task remembers
PIECE = 1 << 16  # characters whose words are held at once
STRETCH = 1 << 14  # windows whose sums are held at once
BITS = 1 << 24
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of each word, also kept in ``known``."""
    out = np.empty(len(words), np.uint64)
    for k, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
        out[k] = h
    return out


def hashed_text(text: str, hashes: Callable[[list[str]], np.ndarray]) -> np.ndarray:
    """``hashes`` of all words of a text; a long one is cut at white space, so that its words never lie in memory together."""
    low, parts, start = text.lower(), [], 0
    while len(low) - start > PIECE and (cut := SPACE.search(low, start + PIECE)):
        parts.append(hashes(WORDS.findall(low, start, cut.start())))
        start = cut.end()
    parts.append(hashes(WORDS.findall(low, start)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


SPACE = re.compile(r"\s")


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ words[j : j + n]) * MIX
        h ^= h >> np.uint64(29)
    return h


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def running_sums(h: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the weights before each shingle, in all and by bit."""
    return np.concatenate([[0.0], np.cumsum(weights)]), np.concatenate([np.zeros((1, 64)), np.cumsum(_bits(h) * weights[:, None], 0)])


def shingle_weight(items: int, times: np.ndarray | int) -> np.ndarray:
    """What a shingle in ``times`` of the items weighs, in whole parts of 2 ** -20: sums are exact, so that fingerprints do not depend on the place."""
    return np.round((1 + np.log(items / times)) * (1 << 20)) / (1 << 20)


def window_fingerprints(total: np.ndarray, ones: np.ndarray, n: int) -> np.ndarray:
    """The weighted SimHash of every n consecutive shingles, from their running sums."""
    return _packed(ones[n:] - ones[:-n] > (total[n:] - total[:-n])[:, None] / 2)


@dataclass
class Times:
    """How many items of a width there are, and in how many of them each shingle of several items is."""

    items: int
    known: np.ndarray  # in order
    times: np.ndarray


@dataclass
class Items:
    """Items of one shingle width, their fingerprints and the block index."""

    width: int
    ids: list
    size: np.ndarray  # in shingles
    bags: list[Counter]
    known: np.ndarray  # all shingles, in order, their weights, and whether these items have them
    weight: np.ndarray
    mine: np.ndarray
    other: float  # the weight of a shingle that no item has
    prints: np.ndarray
    total: np.ndarray  # the items' weights
    holders: tuple[np.ndarray, np.ndarray, np.ndarray]  # where each known shingle's items start, the items, and its weight in each

    @staticmethod
    def of(width: int, ids: list, words: list[np.ndarray], whole: Times | None = None) -> Items:
        """The items, of a benchmark that ``whole`` counts; without it they are all."""
        rows = [shingles(w, width) for w in words]
        own, times = np.unique(np.concatenate([np.unique(r) for r in rows]), return_counts=True)
        whole = whole or Times(len(rows), own, times)
        seen = np.union1d(own, whole.known)
        mine, times = np.isin(seen, own), np.ones(len(seen))
        times[np.searchsorted(seen, whole.known)] = whole.times
        weight = shingle_weight(whole.items, times)
        prints = [window_fingerprints(*running_sums(r, weight[np.searchsorted(seen, r)]), len(r))[0] for r in rows]
        at = np.searchsorted(seen, np.concatenate(rows))
        item = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        pairs, n = np.unique(at * len(rows) + item, return_counts=True)
        at, item = np.divmod(pairs, len(rows))
        total = np.bincount(item, n * weight[at], len(rows))
        holders = np.searchsorted(at, np.arange(len(seen) + 1)), item, n * weight[at]
        return Items(width, ids, np.array([len(r) for r in rows]), [Counter(r.tolist()) for r in rows], seen, weight, mine, float(shingle_weight(whole.items, 1)), np.array(prints, np.uint64), total, holders)

    @cached_property
    def index(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block: items by near block value, and where each value's items start. A worker builds it once, when it first needs it."""
        span = 64 // BLOCKS
        flips = [sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in itertools.combinations(range(span), r)]
        out = []
        for b in range(BLOCKS):
            own = (self.prints >> np.uint64(span * b)).astype(np.int64) & ((1 << span) - 1)
            values = (own[:, None] ^ np.array(flips)[None, :]).ravel()
            items = np.repeat(np.arange(len(own), dtype=np.int32), len(flips))
            order = np.argsort(values, kind="stable")
            out.append((items[order], np.searchsorted(values[order], np.arange((1 << span) + 1))))
        return out

    def weights_of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles' weights, and which of them some item has."""
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        found = self.known[at] == h
        return np.where(found, self.weight[at], self.other), found & self.mine[at]

    def permitted(self, h: np.ndarray, similar: float) -> np.ndarray:
        """The items that a text with the known shingles ``h`` can hold: at least that share of their weight is there."""
        starts, item, mass = self.holders
        at = np.searchsorted(self.known, np.unique(h))
        n = starts[at + 1] - starts[at]
        listed = np.repeat(starts[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.nonzero(np.bincount(item[listed], mass[listed], len(self.ids)) >= similar * self.total - 1e-6)[0]

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingles and an item's."""
        own, bag = Counter(window.tolist()), self.bags[item]
        every = list(own | bag)
        w = self.weights_of(np.array(every, np.uint64))[0]
        low = sum(x * min(own[s], bag[s]) for s, x in zip(every, w, strict=True))
        return float(low / sum(x * max(own[s], bag[s]) for s, x in zip(every, w, strict=True)))


def near_items(prints: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, distance) of all pairs of fingerprints within the radius."""
    span, pairs = 64 // BLOCKS, []
    for b, (listed, starts) in enumerate(items.index):
        value = (prints >> np.uint64(span * b)).astype(np.int64) & ((1 << span) - 1)
        n = starts[value + 1] - starts[value]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs.append(np.repeat(np.arange(len(prints)), n) * len(items.ids) + listed[np.repeat(starts[value], n) + within])
    window, item = np.divmod(np.unique(np.concatenate(pairs)), len(items.ids))
    distance = np.bitwise_count(prints[window] ^ items.prints[item])
    near = distance <= RADIUS
    return window[near], item[near], distance[near]


def stretches(at: np.ndarray, reach: int, n: int) -> Iterator[tuple[int, int]]:
    """(first, end) places of windows that can hold one of the shared shingles ``at``, at most ``STRETCH`` in a row."""
    for run in np.split(at, np.nonzero(np.diff(at) > 2 * reach)[0] + 1):
        low, high = max(0, int(run[0]) - reach + 1), min(n, int(run[-1]) + 1)
        for start in range(low, high, STRETCH):
            yield start, min(high, start + STRETCH)


def matches(words: np.ndarray, items: Items, similar: float) -> list[tuple[int, float, int, int, int]]:
    """(item, similarity, first word, words, distance): for each item a text holds, its nearest window that is similar enough."""
    h = shingles(words, items.width)
    if not len(h):
        return []
    weights, shared = items.weights_of(h)
    at = np.nonzero(shared)[0]
    found: list[tuple[int, float, int, int, int]] = []
    if not len(at):
        return found
    likely = items.permitted(h[at], similar)
    if not len(likely):
        return found
    keys = {item: np.array(list(items.bags[item]), np.uint64) for item in likely.tolist()}
    reach, none = int(items.size.max()), np.zeros(0, np.int64)
    rows = [(none,) * 4]  # distance, item, first place, size
    for first, end in stretches(at, reach, len(h)):
        for size in np.unique(items.size[likely]).tolist():
            n = min(size, len(h))  # a text shorter than the item is one window
            low, high = min(first, len(h) - n), min(len(h), end + n - 1)
            held = np.concatenate([[0], np.cumsum(shared[low:high])])
            starts = np.nonzero(held[n:] > held[:-n])[0]
            if not len(starts):
                continue
            total, ones = running_sums(h[low:high], weights[low:high])
            prints = window_fingerprints(total, ones, n)
            own = likely[items.size[likely] == size]
            window, item, distance = near_items(prints[starts], items)
            fit = np.isin(item, own)
            rows.append((distance[fit].astype(np.int64), item[fit], starts[window[fit]] + low, np.full(fit.sum(), n)))
            whole = total[n:] - total[:-n]
            for item in own.tolist():
                both = np.concatenate([[0.0], np.cumsum(weights[low:high] * np.isin(h[low:high], keys[item]))])
                start = np.nonzero(both[n:] - both[:-n] >= similar / (1 + similar) * (whole + items.total[item]) - 1e-6)[0]
                distance = np.bitwise_count(prints[start] ^ items.prints[item]).astype(np.int64)
                rows.append((distance, np.full(len(start), item), start + low, np.full(len(start), n)))
    table = np.unique(np.stack([np.concatenate(c) for c in zip(*rows, strict=True)], 1), axis=0)  # by distance, item, place
    done: set[int] = set()
    tried: dict[tuple[int, bytes], float] = {}
    for distance, item, start, n in table:
        item, n = int(item), int(n)
        if item in done:
            continue
        window = h[start : start + n]
        key = item, window.tobytes()
        if key not in tried:  # texts that repeat a passage repeat its windows
            if len(tried) > 1000:
                tried.clear()
            tried[key] = items.similarity(window, item)
        if tried[key] >= similar:
            done.add(item)
            found.append((item, tried[key], int(start), n + items.width - 1, int(distance)))
    return found


@dataclass
class Block:
    """Some items by shingle width, and the hashes of all their words."""

    items: list[Items]
    vocabulary: dict[str, int] = field(default_factory=dict)

    def shared(self, text: str) -> bool:
        """Whether a text shares a shingle with an item. Words that no item has need no hash here."""
        get = self.vocabulary.get
        own = hashed_text(text, lambda words: np.fromiter((get(w, 0) for w in words), np.uint64, len(words)))
        unknown = np.concatenate([[0], np.cumsum(own == 0)])
        for items in self.items:
            h = shingles(own, items.width)
            h = h[unknown[items.width :] == unknown[: -items.width]] if len(h) else h
            if len(h) and items.weights_of(h)[1].any():
                return True
        return False


def whole_times(benchmark: DataFrame, text_col: str) -> dict[int, Times]:
    """Counts over all items by shingle width."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width, found = [], []
            for text in texts_of(b, text_col):
                words = word_hashes(words_of(text), {})
                k = min(len(words), SHINGLE)
                own = np.unique(shingles(words, k)).view(np.int64).tolist() if k else []
                width += [k] * (len(own) + 1)
                found += [None, *own]  # the item itself, and its shingles
            yield pa.record_batch({"width": pa.array(width, pa.int64()), "h": pa.array(found, pa.int64())})

    counts = columns(benchmark, text_col).mapInArrow(find, "width long, h long").groupBy("width", "h").count()
    table, out = counts.where("width > 0 AND (h IS NULL OR count > 1)").toArrow(), {}
    width, h, n = (table.column(c).combine_chunks() for c in ("width", "h", "count"))
    for k in width.unique().to_pylist():
        own = width.to_numpy() == k
        alone = own & h.is_null().to_numpy(zero_copy_only=False)
        hashes, times = h.fill_null(0).to_numpy().view(np.uint64)[own & ~alone], n.to_numpy()[own & ~alone]
        order = np.argsort(hashes)
        out[k] = Times(int(n.to_numpy()[alone][0]), hashes[order], times[order])
    return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    whole = whole_times(benchmark, text_col)
    held, known, size = [], {}, 0

    def block() -> Block:
        by_width = {k: [(i, w) for i, w in held if min(len(w), SHINGLE) == k] for k in range(1, SHINGLE + 1)}
        return Block([Items.of(k, [i for i, _ in own], [w for _, w in own], whole[k]) for k, own in by_width.items() if own], known)

    for r in columns(benchmark, id_col, text_col).toLocalIterator():
        words = words_of(r[1] or "")
        if held and (len(held) >= ITEMS or size + len(words) > WORDS_IN_BLOCK):
            yield block()
            held, known, size = [], {}, 0
        held.append((r[0], word_hashes(words, known)))
        size += len(words)
    if held:
        yield block()


def sharing(docs: DataFrame, blocks: list[Block] | Iterator[Block], id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the texts that share a shingle with an item of any block, and perhaps of a few more."""
    bits, widths = np.zeros(BITS, bool), set()
    for block in blocks:
        for items in block.items:
            widths.add(items.width)
            bits[(items.known[items.mine] % np.uint64(BITS)).astype(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast((np.packbits(bits), sorted(widths)))
    rows = columns(docs, id_col, text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, widths = shared.value
        bits, known = np.unpackbits(packed).view(bool), {}

        def share(text: str) -> bool:
            words = hashed_text(text, lambda ws: word_hashes(ws, known))
            if len(known) > KNOWN:
                known.clear()
            return any(bits[(shingles(words, k) % np.uint64(BITS)).astype(np.int64)].any() for k in widths)

        for b in batches:
            yield b.filter(pa.array([share(t) for t in texts_of(b, text_col)], pa.bool_()))

    return rows.mapInArrow(keep, rows.schema)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(id, item, similarity, first_word, n_words, distance) for each benchmark item that a text holds."""
    small_batches(docs.sparkSession)
    rows = columns(docs, id_col, text_col)
    kinds = dict(rows.dtypes) | {"item": dict(benchmark.dtypes)[item_col]}
    schema = f"`{id_col}` {kinds[id_col]}, `{item_col}` {kinds['item']}, similarity double, first_word long, n_words long, distance long"
    ids = rows.schema[id_col].dataType, benchmark.schema[item_col].dataType
    found = docs.sparkSession.createDataFrame([], schema)
    blocks = item_blocks(benchmark, item_col, item_text_col)
    first = list(itertools.islice(blocks, 2))
    if len(first) > 1:  # the benchmark is read again, so that only one block is held at a time
        rows = checkpointed(sharing(rows, item_blocks(benchmark, item_col, item_text_col), id_col, text_col))
    for block in itertools.chain(first, blocks):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            block = shared.value
            known: dict[str, int] = {}
            for b in batches:
                out = []
                for k, text in enumerate(texts_of(b, text_col)):
                    if not block.shared(text):
                        continue
                    words = hashed_text(text, lambda ws: word_hashes(ws, known))
                    out += [(k, items.ids[m[0]], *m[1:]) for items in block.items for m in matches(words, items, similar)]
                    if len(known) > KNOWN:
                        known.clear()
                at, item, *rest = zip(*out, strict=True) if out else [()] * 6
                own = b.column(id_col).take(pa.array(at, pa.int64()))
                kinds = (pa.float64(), pa.int64(), pa.int64(), pa.int64())
                arrays = [own, pa.array(item, to_arrow_type(ids[1])), *(pa.array(x, kind) for x, kind in zip(rest, kinds, strict=True))]
                yield pa.record_batch(arrays, [id_col, item_col, "similarity", "first_word", "n_words", "distance"])

        found = found.unionByName(rows.mapInArrow(search, schema))
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; others of the same id, or of none, stay."""
    key = lambda: F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    keyed = columns(docs, id_col, text_col).select(key().alias("key"), F.col(f"`{text_col}`").alias("text"))
    held = contaminated(keyed, benchmark, similar, "key", "text").select(F.col("key").alias("held")).distinct()
    return docs.join(held, key() == held["held"], "left_anti")
