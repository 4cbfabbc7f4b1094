"""k-means with all restarts, and all numbers of clusters, from the same scans.

Seeds are drawn as in k-means||: each round keeps points by their share of the cost so
far, and the few kept, weighted by the points nearest to them, are thinned to k on the
driver. A step of Lloyd's then is one scan: each task sums its points by nearest centre
for every run that has not settled, a row a run. Points lie in ``PIECE`` to a task or in one task a core,
so that these rows are few, and are added up where they arrive: a step is one job without a shuffle. What a run draws depends on its seed and the
points' values alone, so that a task run again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DRAWS, STEPS, SETTLED = 2, 100, 1e-9
PIECE = 500_000  # points of a task
Run = tuple[int, int]  # number of clusters, seed


@dataclass
class Clusters:
    """Centres in units of (column - mean) / spread, in the order of their numbers."""

    columns: list[str]
    mean: np.ndarray
    spread: np.ndarray
    centres: np.ndarray
    cost: float

    def number(self) -> Column:
        """The number of the nearest centre; of equally near ones the first. Null where a column is."""
        x = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(self.columns, self.mean, self.spread, strict=True)]
        far = F.array(*(sum(((v - float(a)) ** 2 for v, a in zip(x, centre, strict=True)), F.lit(0.0)) for centre in self.centres))
        return (F.array_position(far, F.array_min(far)) - 1).cast("int")

    def own_units(self) -> np.ndarray:
        return self.centres * self.spread + self.mean


def _mixed(u: np.ndarray, salt: int) -> np.ndarray:
    """Numbers from 0 to 1 by the points' hashes and a salt."""
    z = u.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (2 * salt + 1) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))).astype(np.float64) / 2.0**64


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of points to centres."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :], 0)


def _scan(vectors: DataFrame, each: Callable[[np.ndarray, np.ndarray], Iterable[tuple[str, np.ndarray]]], d: int, add: bool = True) -> DataFrame:
    """(name, sums): what ``each`` gives for the hashes and points of a batch, added up by task, or row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        rows: list[tuple[str, np.ndarray]] = []
        for b in batches:
            u = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
            for name, value in each(u, x):
                if add:
                    total[name] = total[name] + value if name in total else value
                else:
                    rows.append((name, value))
        rows += total.items()
        yield pa.record_batch({"name": pa.array([n for n, _ in rows], pa.string()), "sums": pa.array([np.ravel(v).tolist() for _, v in rows], pa.list_(pa.float64()))})

    return vectors.mapInArrow(run, "name string, sums array<double>")


def _summed(found: DataFrame) -> dict[str, np.ndarray]:
    """The tasks' rows (name, sums) added up by name."""
    total: dict[str, np.ndarray] = {}
    for r in found.collect():  # a row a run and task
        total[r.name] = total.get(r.name, 0) + np.array(r.sums)
    return total


def _seeds(vectors: DataFrame, runs: list[Run], d: int) -> dict[Run, np.ndarray]:
    """k starting centres for each run; fewer if there are fewer different points."""
    names = {f"{k}|{s}": (k, s) for k, s in runs}
    salts = {name: 64 * s + 1_000_003 * k for name, (k, s) in names.items()}

    def first(u: np.ndarray, x: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        for name, salt in salts.items():
            drawn = _mixed(u, salt)
            at = int(drawn.argmin())
            yield name, np.concatenate([[drawn[at]], x[at]])

    best: dict[str, np.ndarray] = {}
    for r in _scan(vectors, first, d, add=False).groupBy("name").agg(F.min("sums").alias("sums")).collect():
        best[r.name] = np.array(r.sums[1:])[None, :]
    if not best:
        return {}
    cost = {n: v[0] for n, v in _summed(_scan(vectors, lambda u, x: ((n, np.array([_far(x, c).min(1).sum()])) for n, c in best.items()), d)).items()}
    for turn in range(1, DRAWS + 1):
        held = dict(best)

        def draw(u: np.ndarray, x: np.ndarray, held=held, cost=cost, turn=turn) -> Iterator[tuple[str, np.ndarray]]:
            for name, centres in held.items():
                far = _far(x, centres).min(1)
                for at in np.flatnonzero(_mixed(u, salts[name] + turn) * max(cost[name], 1e-300) < 2 * names[name][0] * far):
                    yield name, x[at]

        kept = _scan(vectors, draw, d, add=False).distinct().collect()  # about 2 k a run and round
        best = {n: np.array(sorted({*map(tuple, c), *(tuple(r.sums) for r in kept if r.name == n)})) for n, c in best.items()}
        if turn < DRAWS:
            cost = {n: v[0] for n, v in _summed(_scan(vectors, lambda u, x, best=best: ((n, np.array([_far(x, c).min(1).sum()])) for n, c in best.items()), d)).items()}
    near = lambda u, x: ((n, np.bincount(_far(x, c).argmin(1), minlength=len(c)).astype(float)) for n, c in best.items())
    weights = _summed(_scan(vectors, near, d))
    return {names[n]: _thinned(c, weights[n], names[n][0], names[n][1]) for n, c in best.items()}


def _thinned(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the weighted points, each drawn by its weight times its distance to those before."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    while len(chosen) < min(k, len(points)):
        share = weights * _far(points, points[chosen]).min(1)
        if not share.sum():
            break
        chosen.append(int(rng.choice(len(points), p=share / share.sum())))
    return points[chosen]


def lloyd(vectors: DataFrame, centres: dict[Run, np.ndarray], d: int) -> dict[Run, tuple[np.ndarray, float, np.ndarray]]:
    """For each run its settled centres, cost, and each cluster's (n, sums, sums of squared norms)."""
    now, done = {f"{k}|{s}": c for (k, s), c in centres.items()}, {}
    for _ in range(STEPS):
        open_ = {n: c for n, c in now.items() if n not in done}
        if not open_:
            break

        def step(u: np.ndarray, x: np.ndarray, open_=open_) -> Iterator[tuple[str, np.ndarray]]:
            norm = (x**2).sum(1)
            for name, c in open_.items():
                far = _far(x, c)
                own = np.eye(len(c))[far.argmin(1)]
                yield name, np.concatenate([[far.min(1).sum()], own.sum(0), (own.T @ x).ravel(), own.T @ norm])

        for name, s in _summed(_scan(vectors, step, d)).items():
            k = len(open_[name])
            n, sums = s[1 : 1 + k], s[1 + k : 1 + k + k * d].reshape(k, d)
            moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], open_[name])  # an empty cluster's centre stays
            if ((moved - open_[name]) ** 2).sum() <= SETTLED:
                done[name] = open_[name], float(s[0]), np.column_stack([n, sums, s[1 + k + k * d :]])
            now[name] = moved
    last = {n: done.get(n) for n in now}
    return {(int(n.split("|")[0]), int(n.split("|")[1])): f if f else (now[n], float("inf"), np.zeros((len(now[n]), d + 2))) for n, f in last.items()}


def vectors_of(df: DataFrame, columns: list[str], scale: bool) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(u, x): a hash and the columns of each row that has them, centred and in units of their sample deviation if ``scale``."""
    kept = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).where(~F.exists(F.array(*columns), lambda v: v.isNull() | F.isnan(v)))
    mean, spread = np.zeros(len(columns)), np.ones(len(columns))
    if scale:
        of = kept.agg(*(F.avg(c) for c in columns), *(F.stddev_samp(c) for c in columns)).first()
        mean, spread = np.array([v or 0.0 for v in of[: len(columns)]]), np.array([v or 1.0 for v in of[len(columns) :]])
    x = F.array(*((F.col(c) - float(m)) / float(s) for c, m, s in zip(columns, mean, spread, strict=True)))
    return kept.select(F.xxhash64(*columns).alias("u"), x.alias("x")), mean, spread


def kmeans_runs(df: DataFrame, columns: list[str], runs: list[Run], scale: bool = True) -> dict[Run, tuple[Clusters, np.ndarray]]:
    """Every run's clusters, in no particular order of numbers, and each cluster's sums; all runs share their scans."""
    vectors, mean, spread = vectors_of(df, columns, scale)
    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-vectors.persist().count() // PIECE))
    pieces = vectors.repartition(tasks, "u").persist()
    try:
        pieces.count()
        vectors.unpersist()
        found = lloyd(pieces, _seeds(pieces, runs, len(columns)), len(columns))
    finally:
        pieces.unpersist()
    return {run: (Clusters(list(columns), mean, spread, centres, cost), sums) for run, (centres, cost, sums) in found.items()}


def silhouettes(df: DataFrame, columns: list[str], found: dict[Run, tuple[Clusters, np.ndarray]], scale: bool = True) -> dict[Run, float]:
    """The mean silhouette of squared distances of every run, from one scan: a point's mean distance to a cluster follows from the cluster's sums."""
    vectors, _, _ = vectors_of(df, columns, scale)
    told = {f"{k}|{s}": (c.centres, sums) for (k, s), (c, sums) in found.items()}

    def each(u: np.ndarray, x: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        norm = (x**2).sum(1)
        for name, (centres, sums) in told.items():
            n, total, square = sums[:, 0], sums[:, 1:-1], sums[:, -1]
            own, at = _far(x, centres).argmin(1), np.arange(len(x))
            far = norm[:, None] * n[None, :] - 2 * x @ total.T + square[None, :]
            inside = far[at, own] / np.maximum(n[own] - 1, 1)
            others = np.where(n[None, :] > 0, far / np.maximum(n, 1)[None, :], np.inf)
            others[at, own] = np.inf
            outside = others.min(1)
            value = np.where((n[own] > 1) & np.isfinite(outside), (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-300), 0.0)
            yield name, np.array([value.sum(), len(x)])

    return {tuple(map(int, n.split("|"))): v[0] / max(v[1], 1) for n, v in _summed(_scan(vectors, each, len(columns))).items()}
