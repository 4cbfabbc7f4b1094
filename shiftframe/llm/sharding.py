"""Shards of near equal bytes, by sampled splitters.

Rows are ordered by a key (hash of the text, then hash of the id), so that equal
texts lie together. A size-weighted sample of keys gives quantile boundaries,
which cut the order into ranges: some for each shard, and as many more as keep a
range near ``RANGE_BYTES``, so that no task sorts more whatever the size of the
corpus; ranges that come out overfull are sampled again and cut further, also
inside a run of equal texts.
Each range's bytes and rows are then counted exactly, so that every row's place
in the whole order is known from its place in its range: shard s takes the
rows whose middle byte lies in the s-th equal part of all bytes. A shard
differs from the mean by about its largest row at most. Sizes come before
company: a run of equal texts that crosses a boundary goes on in the next shard.

A null text has no bytes and the key of an empty one; sizes include a fixed
``overhead``, so that empty texts also weigh something; rows that agree in text
and id are interchangeable and keep their own slots; texts of any length are
whole rows; size, shard and slot take the place of columns of these names, all
others are kept; an empty table gives an empty result. Samples, range totals
and shard starts come to the driver, some 24 bytes for each of ``SAMPLES_PER_RANGE``
samples of a range: about 150 MB at 100 TB.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import apart, checkpointed

RANGES_PER_SHARD, RANGE_BYTES = 8, 256 << 20
SAMPLES_PER_RANGE = 16
OVERFULL = 2.5
ROUNDS = 6


@dataclass
class Splitters:
    """Boundaries in key order; a row's range is the number of boundaries up to its key."""

    h: np.ndarray
    i: np.ndarray

    def ranges(self, h: pd.Series, i: pd.Series) -> np.ndarray:
        low, high = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        for k in np.nonzero(high > low)[0]:  # boundaries inside a run of equal texts
            low[k] += np.searchsorted(self.i[low[k] : high[k]], i.iloc[k], "right")
        return low

    def range_of(self, h: Column, i: Column) -> Column:
        @F.pandas_udf("int")
        def find(h: pd.Series, i: pd.Series) -> pd.Series:
            return pd.Series(self.ranges(h, i).astype(np.int32))

        return find(h, i)

    def looked_up(self, h: Column, i: Column, values: np.ndarray) -> Column:
        """The range's value."""

        @F.pandas_udf("double" if values.dtype.kind == "f" else "long")
        def find(h: pd.Series, i: pd.Series) -> pd.Series:
            return pd.Series(values[self.ranges(h, i)])

        return find(h, i)


def _sample(keys: DataFrame, rate: Column, seed: int) -> np.ndarray:
    """(h, i, weight) of a deterministic sample in which a row of size s is held with probability s * rate."""
    chance = F.least(F.col("size") * rate, F.lit(1.0))
    draw = F.pmod(F.xxhash64("h", "i", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    found = keys.withColumn("chance", chance).where(draw < F.col("chance")).select("h", "i", (F.col("size") / F.col("chance")).alias("w")).toArrow()
    out = np.zeros(found.num_rows, [("h", "i8"), ("i", "i8"), ("w", "f8")])
    for c in out.dtype.names:
        out[c] = found.column(c).to_numpy()
    return out


def _boundaries(sample: np.ndarray, parts: int) -> np.ndarray:
    """At most parts - 1 keys that cut the sample's weight evenly."""
    sample = np.sort(sample, order=["h", "i"])
    if not len(sample):
        return sample
    at = np.searchsorted(np.cumsum(sample["w"]), sample["w"].sum() * np.arange(1, parts) / parts)
    return sample[np.unique(np.minimum(at, len(sample) - 1))]


def _splitters(found: np.ndarray) -> Splitters:
    found = np.unique(found[["h", "i"]])
    return Splitters(found["h"].copy(), found["i"].copy())


def _totals(keys: DataFrame, splitters: Splitters) -> pd.DataFrame:
    """Bytes and rows of each range; the number of ranges is bounded."""
    ranged = keys.groupBy(splitters.range_of(F.col("h"), F.col("i")).alias("r")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    found = ranged.toArrow().to_pandas().set_index("r")
    return found.reindex(range(len(splitters.h) + 1), fill_value=0).astype("int64")


def splitters_of(keys: DataFrame, parts: int, total: int) -> tuple[Splitters, pd.DataFrame]:
    """Boundaries that cut the keys (h, i, size) into about ``parts`` ranges of even bytes, and the ranges' bytes and rows."""
    found = _boundaries(_sample(keys, F.lit(parts * SAMPLES_PER_RANGE / max(total, 1)), 0), parts)
    splitters = _splitters(found)
    counted = _totals(keys, splitters)
    for seed in range(1, ROUNDS):
        full = counted[(counted.bytes > OVERFULL * total / parts) & (counted.rows > 1)]
        if full.empty:
            break
        rates = np.zeros(len(counted))
        rates[full.index] = SAMPLES_PER_RANGE * np.ceil(full.bytes * parts / total) / full.bytes
        again = _sample(keys, splitters.looked_up(F.col("h"), F.col("i"), rates), seed)
        new = _boundaries(again, int(sum(np.ceil(full.bytes * parts / total))) + 1)
        before = len(splitters.h)
        found = np.concatenate([found, new])
        splitters = _splitters(found)
        if len(splitters.h) == before:  # what is left are single keys
            break
        counted = _totals(keys, splitters)
    return splitters, counted


def assign_shards(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with size, shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    size = F.octet_length(text).cast("long") + overhead
    key = {"h": F.xxhash64(text), "i": F.xxhash64(F.col(f"`{id_col}`"))}
    keys = checkpointed(docs.select(key["h"].alias("h"), key["i"].alias("i"), size.alias("size")))
    total = keys.agg(F.sum("size")).first()[0] or 0
    tasks = -(-total // RANGE_BYTES)
    splitters, counted = splitters_of(keys, max(shards * RANGES_PER_SHARD, tasks), total)
    before = (counted.cumsum() - counted).to_numpy()
    spread = tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # more ranges than tasks would be

    p = apart(docs)
    h, i, n, at_range, low, first, end, at, shard = (p + c for c in ("h", "i", "n", "range", "low", "first", "end", "at", "shard"))

    def placed(rows: DataFrame) -> DataFrame:
        """rows (with their hashes and size) and their shard and place in the whole order."""
        own, order = (F.col(h), F.col(i)), Window.partitionBy(at_range).orderBy(h, i, n)
        upto = F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumns({at_range: splitters.range_of(*own), low: splitters.looked_up(*own, before[:, 0]), first: splitters.looked_up(*own, before[:, 1])})
        rows = rows.repartition(tasks, at_range) if spread else rows
        rows = rows.withColumns({end: F.col(low) + upto, at: F.col(first) + F.row_number().over(order) - 1})
        middle = F.col(end) - F.col(n) / 2
        return rows.withColumn(shard, F.least(F.floor(middle * shards / F.lit(float(max(total, 1)))), F.lit(shards - 1)).cast("int"))

    light = keys.select(F.col("h").alias(h), F.col("i").alias(i), F.col("size").alias(n))
    starts = dict(placed(light).groupBy(shard).agg(F.min(at)).collect())
    starts = F.array(*(F.lit(starts.get(s, 0)) for s in range(shards))).cast("array<long>")
    out = placed(docs.withColumns({h: key["h"], i: key["i"], n: size}))
    added = [F.col(n).alias("size"), F.col(shard).alias("shard"), (F.col(at) - starts[F.col(shard)]).alias("slot")]
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("size", "shard", "slot")), *added)
