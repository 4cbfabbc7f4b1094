"""Near-duplicate removal: one document of each group of copies stays.

Texts are joined by two kinds of links. First, those of the SimHash components:
whole-text fingerprints at three differing bits or fewer. Near copies of a few
hundred words mostly differ in more bits, and a wider radius could not be
searched. Second, therefore, SimHashes of samples: each of ``VIEWS`` views takes
the three five-word shingles that its own order puts first, and texts that share
such a fingerprint are candidates; at a similarity of 0.8, all views miss a pair
less than once in a thousand. A first pass links candidates to three texts of
their bucket: the shortest, the longest, and the one that meets most others over
all views, which is the original where copies differ from it and more so from
each other; it verifies those that two views or more propose. Buckets that then still hold texts of different groups are compared
whole, whatever the first pass left out: every pair of sizes that permit the similarity is verified, unless its
texts are in one group by then. Large buckets are dealt out as pairs of chunks,
and each sends out a forest, never its pairs. A link counts if the
Jaccard similarity of the whole shingle sets is ``SIMILAR`` or more. Only
candidates' sets are built, in further passes over the texts: a broadcast of at
most ``BITS`` hash remainders, a bound that does not grow, spares the others.

Texts of any length are read whole, their words in pieces. Texts without words have no shingles and link only by their fingerprint, zero.
Rows that agree in id and text are one document: they stay or go together.
A null text counts as an empty one; a document of null id stays only where its
group has no other; other columns are kept; an empty table gives an empty
result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, columns, small_batches
from .components import connected_components
from .decontamination import KNOWN, hashed_text, shingles, word_hashes
from .simhash import fingerprint, fingerprint_links

VIEWS, SHINGLE, SIMILAR = 10, 5, 0.8
BITS = 1 << 18
CHUNK, SHINGLES = 2048, 1 << 19  # texts, and their shingles, that are compared at once
MAP = 1024  # bits of a set's bitmap


def view_prints(h: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """For each view, the SimHash (bitwise majority) of the three shingles that come first."""
    if len(h) < 3:
        return h[:1]
    out = np.empty(len(orders), np.uint64)
    for k, factor in enumerate(orders):
        a, b, c = h[np.argpartition(h * factor, 2)[:3]]
        out[k] = (a & b) | (b & c) | (a & c)
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes, 0 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def shingle_set(text: str, known: dict[str, int]) -> np.ndarray:
    """The different five-word shingles' hashes in order; fewer words are one shingle."""
    words = hashed_text(text, lambda ws: word_hashes(ws, known))
    return np.unique(shingles(words, min(SHINGLE, max(1, len(words)))))


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, fp, n, views): a hash of the text, its fingerprint, its number of different shingles, and its views' prints."""
    small_batches(docs.sparkSession)
    rows = columns(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), text_hash(text_col).alias("h"), F.col(f"`{text_col}`").alias("text"))
    orders = np.random.default_rng(5).integers(0, 1 << 63, VIEWS, np.uint64) * np.uint64(2) + np.uint64(1)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            fps, sizes, views = [], [], []
            for x in b.column("text"):
                text = x.as_py() or ""
                h = shingle_set(text, known)
                fps.append(fingerprint(text.encode("utf-8", "replace")))
                sizes.append(len(h))
                views.append(view_prints(h, orders).view(np.int64))
            if len(known) > KNOWN:
                known.clear()
            out = {"id": b.column("id"), "h": b.column("h"), "fp": pa.array(np.array(fps, np.uint64).view(np.int64)), "n": pa.array(sizes, pa.int64())}
            yield pa.record_batch(out | {"views": pa.array(views, pa.list_(pa.int64()))})

    return rows.mapInArrow(describe, f"id {dict(rows.dtypes)['id']}, h long, fp long, n long, views array<long>")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def shingle_sets(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(h, shingles) of the texts whose hash is in ``wanted`` (h), and perhaps of a few more."""
    bit = F.pmod(F.col("h"), F.lit(BITS)).cast("int").alias("bit")
    bits = wanted.select(bit).distinct()  # BITS rows at most
    rows = docs.select(text_hash(text_col).alias("h"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("bit", bit).join(F.broadcast(bits), "bit", "left_semi").select("h", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            sets = [shingle_set(x.as_py() or "", known).view(np.int64) for x in b.column("text")]
            if len(known) > KNOWN:
                known.clear()
            yield pa.record_batch({"h": b.column("h"), "shingles": pa.array(sets, pa.list_(pa.int64()))})

    return rows.mapInArrow(build, "h long, shingles array<long>").dropDuplicates(["h"])


def sample_links(texts: DataFrame, docs: DataFrame, similar: float, text_col: str) -> DataFrame:
    """Links (a, b) of text hashes whose shingle sets are similar enough."""
    dealt = texts.select("h", "n", F.posexplode("views").alias("v", "key"))
    sizes = dealt.groupBy("v", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = checkpointed(dealt.join(sizes, ["v", "key"]))
    weights = members.groupBy("h").agg(F.sum(F.log2("size")).alias("weight"))  # how many texts meet it, over all views
    own = F.struct("n", "h")
    ends = members.join(weights, "h").groupBy("v", "key").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.max_by(own, F.struct("weight", "h")).alias("hub"))
    near = members.join(ends, ["v", "key"]).select("n", "h", "v", F.explode(F.array("low", "high", "hub")).alias("o"))
    near = near.where((F.col("h") != F.col("o.h")) & (F.least("n", "o.n") >= similar * F.greatest("n", "o.n")))
    views = near.groupBy(F.least("h", "o.h").alias("a"), F.greatest("h", "o.h").alias("b")).agg(F.size(F.collect_set("v")).alias("views"), F.min(F.least("n", "o.n")).alias("n"))
    pairs = checkpointed(views.where("views > 1 OR n < 3").select("a", "b"))  # fewer shingles than three have one view
    sets = shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("h")), text_col)
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("x"), b.column("y")
            held = [similarity(x[k].values.to_numpy().view(np.uint64), y[k].values.to_numpy().view(np.uint64)) >= similar for k in range(b.num_rows)]
            yield b.select(["a", "b"]).filter(pa.array(held, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def bitmap(h: np.ndarray) -> np.ndarray:
    """Which remainders the hashes have."""
    held = np.zeros(MAP, np.uint8)
    held[(h % np.uint64(MAP)).astype(np.int64)] = 1
    return np.packbits(held).view(np.uint64)


def group_links(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray, size: np.ndarray, earlier: np.ndarray, at: int, similar: float) -> list[tuple[int, int]]:
    """Links (i, j) that join all texts of a bucket that are similar enough and not of one root yet.

    ``side`` is the texts' chunk, ``size`` their class of sizes and ``earlier``
    their prints in the views before this one; pairs that another bucket judges are left to it.
    """
    n, maps, group, links = np.array([len(h) for h in sets]), np.array([bitmap(h) for h in sets]), root.copy(), []
    two = len(np.unique(side)) > 1
    for i in range(len(sets) - 1):
        j = i + 1 + np.nonzero(group[i + 1 :] != group[i])[0]
        j = j[np.minimum(n[i], n[j]) >= similar * np.maximum(n[i], n[j])]
        if two:
            j = j[side[j] != side[i]]
        if size[i] < at:
            j = j[size[j] != size[i]]
        j = j[~(earlier[j] == earlier[i]).any(1)]
        lost = np.maximum(np.bitwise_count(maps[i] & ~maps[j]).sum(1, dtype=np.int64) - n[i], np.bitwise_count(maps[j] & ~maps[i]).sum(1, dtype=np.int64) - n[j])
        j = j[-lost * (1 + similar) >= similar * (n[i] + n[j]) - 1e-6]  # -lost: the most that both can have
        for k in j.tolist():
            if group[k] != group[i] and similarity(sets[i], sets[k]) >= similar:
                links.append((i, k))
                group[group == group[k]] = group[i]
    return links


def bucket_links(texts: DataFrame, joined: DataFrame, docs: DataFrame, similar: float, text_col: str) -> DataFrame:
    """Links (a, b) of similar texts that share a view, sizes permitting, and that ``joined`` (node, root) has in different groups."""
    step = -math.log(similar) * (1 + 1e-9)
    size = F.floor(F.log("n") / max(step, 1e-9))  # sizes that permit the similarity are of one class or of two that follow
    rows = texts.where("n > 0").join(joined.withColumnRenamed("node", "h"), "h", "left").select("h", "n", "views", F.coalesce("root", "h").alias("root"), size.alias("size"))
    dealt = rows.select("h", "n", "views", "root", "size", F.posexplode("views").alias("v", "key"))
    dealt = dealt.select("h", "n", "root", "size", "v", "key", F.slice("views", F.lit(1), F.col("v")).alias("earlier"), F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("at"))
    totals = dealt.groupBy("v", "key", "at").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("size").alias("size"), F.count("*").alias("texts"), F.sum("n").alias("shingled")).where("low <> high AND size = at")  # else all its pairs are judged in the class below
    chunks = F.ceil(F.greatest(F.col("texts") / CHUNK, F.col("shingled") / SHINGLES)).cast("int").alias("k")
    dealt = checkpointed(dealt.join(totals.select("v", "key", "at", chunks), ["v", "key", "at"]).withColumn("mine", F.pmod(F.xxhash64("h"), F.col("k")).cast("int")))
    sets = shingle_sets(docs, dealt.select("h").distinct(), text_col)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
    bucket = ["v", "key", "at", "i", "j"]
    dealt = dealt.join(sets, "h").select(*bucket, "h", "root", "mine", "size", "earlier", "shingles").repartition(*bucket).sortWithinPartitions(*bucket, "h")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[tuple]:
            for b in batches:
                flat = [b.column(c).to_pylist() for c in (*bucket, "h", "root", "mine", "size")]
                yield from zip(zip(*flat[:5], strict=True), *flat[5:], b.column("earlier"), b.column("shingles"), strict=True)

        for (v, _, at, i, j), own in itertools.groupby(members(), lambda m: m[0]):
            rows = [(h, r, m, z, e.values.to_numpy(), x.values.to_numpy().view(np.uint64).copy()) for _, h, r, m, z, e, x in own]
            h, root, mine, size, earlier, found = zip(*rows, strict=True)
            if i < j and len(set(mine)) < 2:
                continue
            links = group_links(list(found), np.array(root), np.array(mine), np.array(size), np.array(earlier, np.int64).reshape(len(h), v), at, similar)
            yield pa.record_batch({"a": pa.array([h[x] for x, _ in links], pa.int64()), "b": pa.array([h[y] for _, y in links], pa.int64())})

    return dealt.mapInArrow(compare, "a long, b long")


def grouped(docs: DataFrame, similar: float = SIMILAR, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All (id, h), and (node, root) of the texts' hashes h that are linked to others."""
    rows = checkpointed(described(docs, id_col, text_col))
    first = rows.groupBy("h").agg(F.min("id").alias("first"))  # of exact copies
    texts = rows.join(first, "h").where(F.col("id").eqNullSafe(F.col("first"))).drop("first")
    texts = checkpointed(texts.dropDuplicates(["h"]))  # by h, as the join
    prints = texts.groupBy("fp").agg(F.min("h").alias("m"))
    alike = texts.select("fp", "h").join(prints, "fp").where("h <> m").select(F.col("h").alias("a"), F.col("m").alias("b"))
    links = fingerprint_links(prints.select("fp"), radius)
    links = links.join(prints.toDF("a", "x"), "a").join(prints.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    joined = connected_components(alike.unionByName(links).unionByName(sample_links(texts, docs, similar, text_col)))
    rest = checkpointed(bucket_links(texts, joined, docs, similar, text_col))
    if not rest.isEmpty():
        joined = connected_components(joined.toDF("a", "b").unionByName(rest))
    return rows.select("id", "h"), joined


def keepers(docs: DataFrame, similar: float = SIMILAR, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All (id, h), and the (h, id) of the document that stays for each group."""
    rows, joined = grouped(docs, similar, radius, id_col, text_col)
    own = rows.groupBy("h").agg(F.min("id").alias("id"))
    groups = joined.withColumnRenamed("node", "h").join(own, "h")
    first = groups.groupBy("root").agg(F.min("id").alias("first"))
    gone = groups.join(first, "root").where(~F.col("id").eqNullSafe(F.col("first"))).select("h")
    return rows, own.join(gone, "h", "left_anti")


def deduplicated(docs: DataFrame, similar: float = SIMILAR, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one document of each group of near copies."""
    rows, kept = keepers(docs, similar, radius, id_col, text_col)
    same = (rows["h"] == kept["h"]) & rows["id"].eqNullSafe(kept["id"])
    gone = rows.join(kept, same, "left_anti").distinct().toDF("__id", "__h")
    return docs.join(gone, text_hash(text_col).eqNullSafe(gone["__h"]) & docs[id_col].eqNullSafe(gone["__id"]), "left_anti")
