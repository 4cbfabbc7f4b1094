"""SimHash near-duplicates: whole texts' fingerprints, linked through pivot distance tables.

Links are those of fingerprints at ``radius`` differing bits or fewer. With the
64 bits cut into ``radius + 3`` blocks, linked fingerprints agree in three
blocks at least, so each fingerprint goes to one bucket for every choice of
three blocks, and nothing linked is missed. In a bucket, the Hamming distances
to reference fingerprints (pivots) are tabled once; by the triangle inequality
a pair whose coordinates differ by more than the radius anywhere is no link,
and the pairs that are left are verified. Pivots alone could not propose
pairs: distances to any pivot crowd around 32, so that half of all pairs
survive each one; as a filter over bucket mates they leave few.

A bucket sends out a spanning forest of its links, never its pairs. Buckets of
more than ``CHUNK`` members are dealt out as pairs of chunks.

Equal fingerprints meet first, as one; copies cost no more than a row, and of
equal distances none is preferred, as every link counts. Texts of any length are
read whole, their shingles in blocks. A bit that exactly half of the shingles
have is 0. A text
without words (null, empty, white space) has the fingerprint zero and links
like any other; repeated rows each get a row; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, columns, small_batches
from .components import connected_components

CHUNK = 2048
SEED = 42
PIVOTS = 16
BLOCK = 1 << 17  # shingles whose bits are counted at once


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set, highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def fingerprint(text: bytes, words_in_shingle: int = 3) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    n = len(words) - words_in_shingle + 1
    if not words:
        return 0
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(words_in_shingle)), strict=False))
    counts = np.zeros(64, np.int64)
    for start in range(0, n, BLOCK):
        m = min(BLOCK, n - start)
        counts += bit_counts(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in itertools.islice(shingles, m)), np.uint64, m))
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words_in_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each row; fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    rows = columns(docs, id_col, text_col).withColumn(text_col, F.col(f"`{text_col}`").cast("binary"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x.as_py() or b"", words_in_shingle) for x in b.column(1)], np.uint64)
            yield pa.record_batch({id_col: b.column(0), "fp": pa.array(found.view(np.int64))})

    return rows.mapInArrow(digest, f"`{id_col}` {dict(rows.dtypes)[id_col]}, fp long")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_masks(radius: int) -> list[int]:
    """Masks of every choice of three of the ``radius + 3`` blocks of the 64 bits, as signed longs."""
    n = radius + 3
    cuts = [64 * k // n for k in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]
    return [int(np.uint64(sum(c)).view(np.int64)) for c in itertools.combinations(blocks, 3)]


def pivots() -> np.ndarray:
    """Reference fingerprints from a fixed generator."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, PIVOTS, np.uint64)


def bucket_links(fps: np.ndarray, radius: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of positions within the radius: pivot table first, then the distance itself."""
    table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)
    found = [], []
    for i in range(len(fps) - 1):
        j = np.arange(i + 1, len(fps))
        for k in range(0, len(refs), 4):  # a few coordinates at a time: most pairs go early
            j = j[(np.abs(table[j, k : k + 4] - table[i, k : k + 4]) <= radius).all(1)]
        j = j[np.bitwise_count(fps[j] ^ fps[i]) <= radius]
        found[0].append(np.full(len(j), i))
        found[1].append(j)
    return np.concatenate(found[0]), np.concatenate(found[1])


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the pairs join, at most n - 1 of them."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    kept = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def fingerprint_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints ``fp`` within the radius, directly or through others."""
    masks, refs = block_masks(radius), pivots()
    tables = F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)))
    dealt = distinct.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    hot = dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    dealt = dealt.join(hot, ["t", "key"], "left").withColumn("k", F.ceil(F.coalesce("n", F.lit(1)) / CHUNK).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    buckets = dealt.groupBy("t", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).agg(F.collect_list("fp").alias("fps"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links = []
            for row in b.column(0):
                fps = np.sort(row.values.to_numpy()).view(np.uint64)
                links += [(fps[x], fps[y]) for x, y in forest(len(fps), *bucket_links(fps, radius, refs))]
            a, z = np.array(links, np.uint64).reshape(-1, 2).view(np.int64).T
            yield pa.record_batch({"a": pa.array(a), "b": pa.array(z)})

    return buckets.where(F.size("fps") > 1).select("fps").mapInArrow(compare, "a long, b long").distinct()


def simhash_components(docs: DataFrame, radius: int = 3, words_in_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id reachable over links."""
    marked = checkpointed(fingerprints(docs, words_in_shingle, id_col, text_col))
    own = marked.groupBy("fp").agg(F.min(id_col).alias("first"))
    nodes = connected_components(fingerprint_links(own.select("fp"), radius)).withColumnRenamed("node", "fp")
    smallest = nodes.join(own, "fp").groupBy("root").agg(F.min("first").alias("joined"))
    linked = nodes.join(smallest, "root").select("fp", "joined")
    classes = own.join(linked, "fp", "left").select("fp", F.coalesce("joined", "first").alias("component_id"))
    return marked.join(classes, "fp").select(id_col, "fp", "component_id")
