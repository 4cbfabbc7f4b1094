"""Ranked lexical search: a K2-treap over the grid of terms and documents in each range of documents.

``indexed`` makes one row for each range of up to 1024 documents: a quadtree over (term, document) whose
cells hold the greatest impact below them, as the drop from their parent's, and a four-bit mask of the
quarters that are not empty. Cells stand level by level in Z-order, so that a mask's running count of
bits leads to its children. Maxima stay in their cells when the next level is made, so that the path of
one term needs no other. Terms are rows, the most frequent first; documents are columns, by id.

``search`` follows the rows of all of an item's terms at once. Its state is a range of documents with
one cell a term, bounded by the sum of weight times maximum; the ranges of the greatest bounds
are halved first, some at a time, until no bound reaches the tenth score. A task keeps each item's ten
best over all ranges that it has read, so that later ranges are given up early.

Impacts need the number of documents and of terms, weights need document frequencies: one pass before
counts both, for the items' terms only, without gathering texts. Items reach the tasks in chunks, at
most 64 MB of them at once; larger benchmarks take further passes over the written index.

A null text has no term and is no result; neither is a document that shares no term with the item, or
scores 0. Equal scores go by ascending id, null ids last; repeated rows are documents of their own;
items of the same id and text are ranked once, of the same id and different texts each, and an item without
terms has no rows. Texts have any length, a very long one is a range of its own. Other
columns are ignored; an empty table of either kind gives an empty result.
"""

from __future__ import annotations

import itertools
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, columns, small_batches, texts_of

#: Documents and (term, document) pairs of a range, at most (but for one longer text).
RANGE_DOCS, RANGE_PAIRS = 1 << 10, 1 << 19
#: Ranges of documents that are halved at a time.
AT_ONCE = 128
#: Bytes of items in a chunk, and chunks that are broadcast at a time.
CHUNK_BYTES, CHUNKS = 4 << 20, 16
#: Terms that a task counts before it hands their counts on.
TERMS_HELD = 1 << 18
#: Letters and digits stand for themselves, A-Z for a-z, bytes above ASCII for themselves; all else parts terms.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: The bits of a number, spread to every second place.
SPREAD = sum(((np.arange(1 << 16, dtype=np.uint64) >> np.uint64(b)) & np.uint64(1)) << np.uint64(2 * b) for b in range(16))
BITS = np.array([i.bit_count() for i in range(16)], dtype=np.uint8)
INDEX = "ids array<long>, terms binary, height int, masks binary, drops binary, width int"


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(LOWER).split()


def _spread(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    return SPREAD[x & np.uint64(0xFFFF)] | SPREAD[x >> np.uint64(16)] << np.uint64(32)


def statistics(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n_docs, n_terms) of each of ``terms``, and in the row of the empty term the documents with a term and all their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        n_terms = 0

        def flush() -> pa.RecordBatch:
            out = pa.record_batch({"term": pa.array(found.keys(), pa.binary()), "n_docs": pa.array(found.values(), pa.int64()), "n_terms": pa.array([n_terms * (t == b"") for t in found], pa.int64())})
            found.clear()
            return out

        for b in batches:
            for text in texts_of(b, text_col):
                if own := terms_of(text):
                    n_terms += len(own)
                    found.update({b"", *own})
                if len(found) > TERMS_HELD:
                    yield flush()
                    n_terms = 0
        if found:
            yield flush()

    counted = columns(docs, text_col).mapInArrow(count, "term binary, n_docs long, n_terms long")
    wanted = terms.select("term").distinct().unionByName(docs.sparkSession.createDataFrame([(bytearray(),)], "term binary"))
    return counted.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms"))


def _range(ids: list, counts: list[Counter], n_docs: int, n_terms: int) -> dict:
    """The quadtree of one range of documents."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    rows_of: dict[bytes, int] = {}
    sizes = np.array([len(counts[k]) for k in order])
    rows = np.fromiter((rows_of.setdefault(t, len(rows_of)) for k in order for t in counts[k]), np.int64, sizes.sum())
    tf = np.fromiter((n for k in order for n in counts[k].values()), np.int64, len(rows))
    long = np.array([10 + 90 * counts[k].total() * n_docs // n_terms for k in order])
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(long, sizes))
    frequent = np.argsort(-np.bincount(rows, minlength=len(rows_of)), kind="stable")
    row = np.empty(len(frequent), np.int64)
    row[frequent] = np.arange(len(frequent))
    terms = list(rows_of)
    height = max(len(rows_of) - 1, len(ids) - 1, 1).bit_length()
    codes = _spread(row[rows]) << np.uint64(1) | _spread(np.repeat(np.arange(len(order)), sizes))
    by = np.argsort(codes)
    codes, value = codes[by], impact[by]
    masks, drops = [], []
    for _ in range(height):
        quarter = np.left_shift(1, (codes & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
        codes = codes >> np.uint64(2)
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        above = np.maximum.reduceat(value, first)
        drops.append(np.repeat(above, np.diff(np.append(first, len(codes)))) - value)
        masks.append(np.bitwise_or.reduceat(quarter, first))
        codes, value = codes[first], above
    drop = np.concatenate([value, *reversed(drops)])  # the root's in full
    width = 2 if drop[1:].max(initial=0) < 1 << 16 and drop[0] < 1 << 16 else 4
    return {"ids": [ids[k] for k in order], "terms": b" ".join(terms[k] for k in frequent), "height": height, "masks": np.concatenate(masks[::-1]).tobytes(), "drops": drop.astype(f"<u{width}").tobytes(), "width": width}


def indexed(docs: DataFrame, n_docs: int, n_terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of ``INDEX`` for each range of documents; ``n_docs`` and ``n_terms`` as ``statistics`` counts them."""
    small_batches(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, pairs = [], [], 0

        def batch() -> pa.RecordBatch:
            row = _range(ids, counts, n_docs, n_terms)
            types = (pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32())
            ids.clear()
            counts.clear()
            return pa.record_batch({c: pa.array([v], t) for (c, v), t in zip(row.items(), types, strict=True)})

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), texts_of(b, text_col), strict=True):
                if not (own := Counter(terms_of(text))):
                    continue
                if ids and (len(ids) == RANGE_DOCS or pairs + len(own) > RANGE_PAIRS):
                    yield batch()
                    pairs = 0
                ids.append(i)
                counts.append(own)
                pairs += len(own)
        if ids:
            yield batch()

    return columns(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long"), f"`{text_col}`").mapInArrow(build, INDEX)


class Range:
    """One row of the index, unpacked."""

    def __init__(self, ids: list, terms: bytes, height: int, masks: bytes, drops: bytes, width: int):
        self.ids, self.height = ids, height
        self.rows = {t: k for k, t in enumerate(terms.split(b" "))}
        self.masks = np.frombuffer(masks, np.uint8)
        bits = BITS[self.masks]
        self.child = 1 + np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))[:-1]
        self.most = np.frombuffer(drops, f"<u{width}").astype(np.int64)
        start, stop = 0, 1
        for _ in range(height):
            first = stop
            last = int(self.child[stop - 1] + bits[stop - 1])
            self.most[first:last] = np.repeat(self.most[start:stop], bits[start:stop]) - self.most[first:last]
            start, stop = first, last

    def best(self, terms: list[bytes], weights: list[int], kept: list[tuple], k: int) -> None:
        """``kept``, the ``k`` least of (-score, id is null, id), with this range's documents considered."""
        here = [(self.rows[t], w) for t, w in zip(terms, weights, strict=True) if t in self.rows and w]
        if not here:
            return
        rows, weight = np.array([r for r, _ in here]), np.array([w for _, w in here])
        cells = np.zeros((1, len(here)), np.int64)
        level, first = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = (self.most[cells] * weight).sum(1)
        while len(bound):
            least = -kept[-1][0] if len(kept) == k else 1
            open_ = bound >= least
            if not open_.all():
                cells, level, first, bound = cells[open_], level[open_], first[open_], bound[open_]
                if not len(bound):
                    break
            if len(bound) > AT_ONCE:
                top = np.argpartition(-bound, AT_ONCE)
                now, later = top[:AT_ONCE], top[AT_ONCE:]
            else:
                now, later = np.arange(len(bound)), np.arange(0)
            done = level[now] == self.height
            for at in now[done].tolist():  # a single document: the bound is its score
                i = self.ids[first[at]]
                entry = (-int(bound[at]), i is None, i or 0)
                if len(kept) < k or entry < kept[-1]:
                    insort(kept, entry)
                    del kept[k:]
            now = now[~done]
            shift = (self.height - 1 - level[now])[:, None]
            quarter = (rows[None, :] >> shift & 1) << 1
            own, found = cells[now], [(cells[later], level[later], first[later], bound[later])]
            mask = np.where(own >= 0, self.masks[own], 0)
            for half in (0, 1):
                q = quarter | half
                at = self.child[own] + BITS[mask & ((1 << q) - 1)]
                at = np.where(mask >> q & 1, at, -1)
                most = np.where(at >= 0, self.most[at], 0)
                found.append((at, level[now] + 1, first[now] + (half << shift[:, 0]), (most * weight).sum(1)))
            cells, level, first, bound = (np.concatenate(x) for x in zip(*found, strict=True))


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, key, term): each item's terms, once; ``key`` tells texts of one id apart."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, t) for k, text in enumerate(texts_of(b, text_col)) for t in sorted(set(terms_of(text)))]
            at = pa.array([k for k, _ in found], pa.int64())
            yield pa.record_batch({"item": b.column(0).take(at), "key": b.column(1).take(at), "term": pa.array([t for _, t in found], pa.binary())})

    rows = columns(items, id_col, text_col).select(F.col(f"`{id_col}`").alias("item"), F.sha2(F.col(f"`{text_col}`"), 256).alias("key"), f"`{text_col}`").dropDuplicates(["item", "key"])
    return rows.mapInArrow(split, f"item {rows.dtypes[0][1]}, key string, term binary")


def search(index: DataFrame, weighed: DataFrame, k: int = 10) -> DataFrame:
    """(item, key, doc_id, score, rank) of the ``k`` best documents; ``weighed`` has item, key, term, weight.

    ``index`` is read once for each 64 MB of items; write it before if they are more.
    """
    by_item = weighed.groupBy("item", "key").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"), F.sum(F.length("term") + 16).alias("size"))
    n_chunks = -(-(by_item.agg(F.sum("size")).first()[0] or 0) // CHUNK_BYTES)
    if n_chunks > CHUNKS:
        index = checkpointed(index)
    kind = dict(weighed.dtypes)["item"]
    schema = f"item {kind}, key string, doc_id long, score long"

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list[tuple]] = {}
        types: list[pa.DataType] = []
        for b in batches:
            types = [b.schema.field("items").type.value_type.field("item").type]
            held = None
            for row in range(b.num_rows):
                *cells, items = (c[row].as_py() for c in b.columns)
                if held is None or held[0] != cells:  # each chunk of items comes with the range again
                    held = cells, Range(*cells)
                for x in items:
                    held[1].best(x["terms"], x["weights"], kept.setdefault((x["item"], x["key"]), []), k)
        for group in itertools.batched(kept.items(), 1024):
            found = [(*item, None if null else i, -score) for item, own in group for score, null, i in own]
            items, keys, ids, scores = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.record_batch({"item": pa.array(items, types[0]), "key": pa.array(keys, pa.string()), "doc_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    found = None
    for start in range(0, n_chunks, CHUNKS):
        share = F.pmod(F.xxhash64("item", "key"), F.lit(n_chunks))
        some = by_item.where((share >= start) & (share < start + CHUNKS))
        chunks = some.groupBy(share.alias("chunk")).agg(F.collect_list(F.struct("item", "key", "terms", "weights")).alias("items")).drop("chunk")
        part = index.crossJoin(F.broadcast(chunks)).mapInArrow(best, schema)  # a few chunks of bounded size meet each range
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = weighed.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("item", "key").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, rank, doc_id, score): the ``k`` best documents of each item."""
    small_batches(docs.sparkSession)
    terms = checkpointed(_item_terms(items, item_col, item_text_col))
    counted = checkpointed(statistics(docs, terms, text_col))
    whole = counted.where(F.length("term") == 0).first()
    n_docs, n_terms = (whole.n_docs, whole.n_terms) if whole else (0, 1)
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("n_docs") + 1))).cast("long")
    weighed = terms.join(counted.select("term", weight.alias("weight")), "term").where("weight > 0")
    found = search(indexed(docs, n_docs, n_terms, id_col, text_col), weighed, k)
    return found.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score")
