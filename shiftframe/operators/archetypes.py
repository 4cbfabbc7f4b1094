"""Player archetypes by k-means, and the models and metrics around them, on pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import replace

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees
from .clusters import Clusters, kmeans_runs, silhouettes
from .folded import Fit, Linear, balanced_folds, complete, cross_scored, kept_folds, logistic_fits
from .ordering import sums_before
from .trees import Boosted, Forest

PARALLEL = 8  # fits that run at once, as their jobs are short


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` kept while several fits read it."""
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def _each(make: Callable, items: Iterable) -> list:
    with ThreadPoolExecutor(PARALLEL) as pool:
        return list(pool.map(make, items))


def scaled(columns: list[str]) -> list:
    """Stages that put the columns, standardised, into the vector ``x``."""
    return [VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True)]


def plain(columns: list[str]) -> list:
    """Stages that put the columns as they are into the vector ``x``."""
    return [VectorAssembler(inputCols=columns, outputCol="x", handleInvalid="skip")]


def kmeans(train: DataFrame, columns: list[str], k: int = 3, seeds: Iterable[int] = range(42, 92), order_by: str | None = None, scale: bool = True) -> Clusters:
    """The clusters of least cost over the seeds, numbered by the centres' ``order_by``; all seeds share their scans.

    Labels of k-means are arbitrary; numbering them by one feature of the
    centres makes them the same from run to run.
    """
    found = [c for c, _ in kmeans_runs(train, columns, [(k, s) for s in seeds], scale).values()]
    best = min(found, key=lambda c: c.cost)
    order = np.argsort(best.centres[:, columns.index(order_by or columns[0])], kind="stable")
    return replace(best, centres=best.centres[order])


def assigned(model: Clusters, df: DataFrame) -> DataFrame:
    """``df`` with cluster, without the rows that lack a column."""
    return df.withColumn("cluster", model.number()).where("cluster is not null")


def centers(model: Clusters, df: DataFrame) -> DataFrame:
    """(cluster, columns): the centres in the columns' own units."""
    rows = [(k, *map(float, c)) for k, c in enumerate(model.own_units())]
    return df.sparkSession.createDataFrame(rows, ["cluster", *model.columns])


def k_sweep(train: DataFrame, columns: list[str], ks: range = range(2, 9), seeds: Iterable[int] = range(42, 52)) -> DataFrame:
    """(k, inertia, silhouette) of each number of clusters, at the least cost over the seeds; the silhouette is of squared distances."""
    seeds = list(seeds)
    with cached(train.select(*columns)) as rows:
        runs = kmeans_runs(rows, columns, [(k, s) for k in ks for s in seeds])
        best = {k: min(((k, s) for s in seeds), key=lambda r: runs[r][0].cost) for k in ks}
        shape = silhouettes(rows, columns, {r: runs[r] for r in best.values()})
    return train.sparkSession.createDataFrame([(k, runs[r][0].cost, float(shape[r])) for k, r in best.items()], "k int, inertia double, silhouette double")


def principal_axes(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, pc1, pc2) of the standardised columns; each axis' sign makes its largest weight positive."""
    model = Pipeline(stages=[*scaled(columns), PCA(k=2, inputCol="x", outputCol="pc")]).fit(df)
    weights = model.stages[-1].pc.toArray()
    signs = [1.0 if weights[abs(weights[:, k]).argmax(), k] > 0 else -1.0 for k in range(2)]
    pc = vector_to_array("pc")
    return model.transform(df).select(*keys, *((pc[k] * signs[k]).alias(f"pc{k + 1}") for k in range(2)))


def axis_clusters(df: DataFrame, columns: list[str], keys: list[str], k: int = 3, seeds: Iterable[int] = range(42, 92)) -> DataFrame:
    """``principal_axes`` with cluster: k-means fitted anew on the two axes, for drawing boundaries."""
    axes = principal_axes(df, columns, keys)
    return assigned(kmeans(axes, ["pc1", "pc2"], k, seeds, scale=False), axes)


def role_model(train: DataFrame, columns: list[str], label: str, c: float = 1.0, scale: bool = True, n: int | None = None) -> PipelineModel:
    """Multinomial logistic regression with the penalty 1 / (c n), on standardised columns or, without ``scale``, plain ones."""
    n = train.count() if n is None else n
    fit = LogisticRegression(featuresCol="x", labelCol=label, family="multinomial", regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=100, probabilityCol="p", rawPredictionCol="rawp", predictionCol="hit")
    return Pipeline(stages=[*(scaled(columns) if scale else plain(columns)), fit]).fit(train)


def role_probabilities(model: PipelineModel, df: DataFrame, k: int = 3) -> DataFrame:
    """``df`` with p_to0 and so on; roles that the training rows lack have 0."""
    p = vector_to_array("p")
    return model.transform(df).withColumns({f"p_to{j}": F.coalesce(F.get(p, F.lit(j)), F.lit(0.0)) for j in range(k)}).drop("raw", "x", "p", "rawp", "hit")


#: The least rows to train on and to test on, by position.
GATES = {"F": (200, 50), "D": (80, 30)}


def expanding_probabilities(
    df: DataFrame, columns: list[str], label: str, seasons: list[int] | None = None, scale: bool = True, gates: dict[str, tuple[int, int]] | None = None, group: str | None = None
) -> DataFrame | None:
    """Each season's probabilities, and ``majority``, by the models of all seasons before it; one model a ``group`` if given.

    All seasons of the data with earlier ones are taken if none are named.
    Splits below the group's gates, or empty, are left out; None if all are.
    All splits are fitted together, and scored in one pass through a table of one
    row each; only counts and the fits' sums come to the driver. ``df`` is counted,
    fitted and scored: where it is not cheap, hand over ``checkpointed`` rows.
    """
    own = F.col(group) if group else F.lit("")
    counts = [tuple(r) for r in df.groupBy(own.alias("g"), "season", F.col(label).alias("y")).count().orderBy("g", "season", "y").collect()]
    splits = []
    for g in dict.fromkeys(c[0] for c in counts):
        least = (gates or {}).get(g, (1, 1))
        for s in seasons or dict.fromkeys(c[1] for c in counts if c[0] == g):
            train = [(y, n) for h, season, y, n in counts if h == g and season < s]
            size = sum(n for _, n in train), sum(n for h, season, _, n in counts if h == g and season == s)
            if size[0] >= least[0] and size[1] >= least[1]:
                by_label = {}
                for y, n in train:
                    by_label[y] = by_label.get(y, 0) + n
                splits.append((g, s, size[0], max(by_label, key=by_label.get), len(by_label)))

    if not splits:
        return None
    part = F.concat_ws("|", own.cast("string"), F.col("season").cast("string"))
    rows = complete(df.withColumn("part", part), columns)
    seen = {(g, season) for g, season, _, _ in counts}
    fits = {f"{g}|{s}": Fit(frozenset(f"{h}|{season}" for h, season in seen if h == g and season < s), scale=scale) for g, s, *_ in splits}
    models = logistic_fits(rows, columns, label, fits, classes=3)
    most = df.sparkSession.createDataFrame([(f"{g}|{s}", float(majority)) for g, s, _, majority, _ in splits], "part string, majority double")
    rows = rows.join(models.table(df.sparkSession, {name: [name] for name in fits}).join(most, "part"), "part")  # a row a split
    rows = rows.withColumn("__z", F.array(*(models.scores(j) for j in range(3)))).withColumn("__z", F.transform("__z", lambda z: F.exp(z - F.array_max("__z"))))
    total = F.col("__z")[0] + F.col("__z")[1] + F.col("__z")[2]
    return rows.withColumns({f"p_to{j}": F.col("__z")[j] / total for j in range(3)}).drop("part", "model", "w", "b", "__z")


def _predicted(k: int) -> Column:
    p = F.array(*(F.col(f"p_to{j}") for j in range(k)))
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def class_metrics(df: DataFrame, label: str, k: int = 3, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, accuracy, baseline, log_loss) of p_to columns: the baseline says the training rows' most frequent label
    (the column ``majority``), or without that column the most frequent one here."""
    hit, y = _predicted(k), F.col(label)
    own = F.greatest(F.element_at(F.array(*(F.col(f"p_to{j}") for j in range(k))), y.cast("int") + 1), F.lit(1e-15))
    counts = [F.count_if(y == j) for j in range(k)]
    baseline = F.avg((F.col("majority") == y).cast("double")) if "majority" in df.columns else F.greatest(*counts) / F.count("*")
    found = {"n": F.count("*"), "accuracy": F.avg((hit == y).cast("double")), "baseline": baseline, "log_loss": F.avg(-F.log(own))}
    return df.groupBy(*(keys or [])).agg(*(c.alias(n) for n, c in found.items()))


def confusion(df: DataFrame, label: str, predicted: str, k: int = 3) -> DataFrame:
    """(label, to0, to1, ...): how often each label was predicted as each; a row for every label."""
    every = df.sparkSession.range(k).select(F.col("id").cast("int").alias("label"))
    counts = df.groupBy(F.col(label).cast("int").alias("label")).agg(*(F.count_if(F.col(predicted).cast("int") == j).alias(f"to{j}") for j in range(k)))
    return every.join(counts, "label", "left").na.fill(0)


def class_report(df: DataFrame, label: str, predicted: str, k: int = 3) -> DataFrame:
    """(label, precision, recall, f1, support); what has no rows to divide by is 0."""
    table = confusion(df, label, predicted, k)
    row = sum((F.col(f"to{j}") for j in range(1, k)), F.col("to0"))
    said = table.agg(*(F.sum(f"to{j}").alias(f"said{j}") for j in range(k)))
    both = table.join(F.broadcast(said))  # one row
    pick = lambda name: F.element_at(F.array(*(F.col(f"{name}{j}") for j in range(k))), F.col("label") + 1)
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    measured = both.select("label", over(pick("to"), pick("said")).alias("precision"), over(pick("to"), row).alias("recall"), row.alias("support"))
    p, r = F.col("precision"), F.col("recall")
    return measured.select("label", "precision", "recall", over(2 * p * r, p + r).alias("f1"), "support")


def binary_metrics(df: DataFrame, prob: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """(auc, brier, log_loss, accuracy): the area by the ranks' sum, ties at their mean rank."""
    keys = keys or []
    p, y = F.col(prob), F.col(label).cast("double")
    by_value = df.groupBy(*keys, p.alias("__p")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    won = sums_before(by_value, "__p", ["neg"], keys).withColumn("won", F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    area = won.groupBy(*keys).agg(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auc"))
    held = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    rest = df.groupBy(*keys).agg(F.avg((p - y) ** 2).alias("brier"), F.avg(-(y * F.log(held) + (1 - y) * F.log(1 - held))).alias("log_loss"), F.avg(((p >= 0.5) == (y > 0.5)).cast("double")).alias("accuracy"))
    return area.join(rest, keys) if keys else area.join(F.broadcast(rest))  # a row each


Make = Callable[[str, int], Estimator]  # from the label's column and the number of rows to train on


def cross_validated(df: DataFrame, columns: list[str], label: str, group: str, make: Make, folds: int = 5, scale: bool = True, out: str = "prob") -> DataFrame:
    """``df`` with fold and ``out``, each row scored by a model that has not seen its group.

    ``out`` is the probability of label 1, or for a regressor its value. Folds are
    balanced by size, unless ``df`` has a column ``fold``.
    """
    rows = df if "fold" in df.columns else balanced_folds(df, group, folds)
    sizes = dict(rows.groupBy("fold").count().collect())

    def scored(k: int) -> DataFrame:
        n = sum(sizes.values()) - sizes.get(k, 0)
        model = Pipeline(stages=[*(scaled(columns) if scale else plain(columns)), make(label, n)]).fit(rows.where(F.col("fold") != k))
        found = model.transform(rows.where(F.col("fold") == k))
        return found.withColumn(out, vector_to_array("p")[1] if "p" in found.columns else F.col("guess")).select(*rows.columns, out)

    parts = _each(scored, sorted(sizes))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


_OUT = {"featuresCol": "x", "probabilityCol": "p", "rawPredictionCol": "rawp", "predictionCol": "hit"}


def logistic(c: float = 0.1) -> Make:
    return lambda label, n: LogisticRegression(labelCol=label, regParam=1.0 / (c * max(n, 1)), standardization=False, **_OUT)


def grid(sizes: tuple[int, ...] = (300, 600), rounds: tuple[int, ...] = (200, 400), depths: dict[str, tuple[int | None, ...]] | None = None) -> dict[str, Fit | Forest | Boosted]:
    """All points of the search by name: penalties, forests and boosted trees."""
    own = {"forest": (6, 10, None), "boosted": (3, 5, None)} | (depths or {})
    points: dict[str, Fit | Forest | Boosted] = {f"logistic C={c}": Fit(frozenset(), c) for c in (0.01, 0.1, 1.0, 10.0)}
    points |= {f"forest trees={t} depth={d} leaf={m}": Forest(t, d, m) for t in sizes for d in own["forest"] for m in (1, 5)}
    return points | {f"boosted rate={r} depth={d} rounds={k}": Boosted(k, d, r) for r in (0.03, 0.05, 0.1) for d in own["boosted"] for k in rounds}


MEASURES = ("auc", "brier", "log_loss")


def fold_scores(scored: DataFrame, label: str, measures: tuple[str, ...] = MEASURES, keys: list[str] | None = None) -> DataFrame:
    """Mean and sample deviation of the folds' measures: a row for each of ``keys``, or one."""
    by_fold = binary_metrics(scored, "prob", label, [*(keys or []), "fold"])
    return by_fold.groupBy(*(keys or [])).agg(*(f(c).alias(f"{c}_{n}") for c in measures for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


def grid_search(df: DataFrame, columns: list[str], label: str, group: str, points: dict[str, Fit | Forest | Boosted], folds: int = 5) -> DataFrame:
    """(model, auc_mean, auc_std, ...) of every point by the same balanced folds, a row each. Logistic points share their scans, and so do trees."""
    names = [f"{c}_{n}" for c in MEASURES for n in ("mean", "std")]
    with kept_folds(df, group, folds) as df:
        linear, grown = ({name: p for name, p in points.items() if isinstance(p, Fit) == own} for own in (True, False))
        scored = [cross_scored(df, columns, label, linear, folds).select("model", "fold", label, "prob")] if linear else []
        scored += [trees.cross_scored(df, columns, label, grown, folds)] if grown else []
        out = [tuple(r) for part in scored for r in fold_scores(part, label, keys=["model"]).select("model", *names).collect()]
    return df.sparkSession.createDataFrame(out, "model string, " + ", ".join(f"{n} double" for n in names))


def regressors(alpha: float = 1.0) -> dict[str, tuple[Make, bool]]:
    """Ridge for a numeric label, and whether columns are standardised first."""
    return {"ridge": (lambda label, n: LinearRegression(labelCol=label, elasticNetParam=0.0, regParam=alpha / max(n, 1), standardization=False, featuresCol="x", predictionCol="guess"), True)}


def tree_regressors(size: int = 600, rounds: int = 200) -> dict[str, Forest | Boosted]:
    """The forest and the boosted trees for a numeric label."""
    return {"forest": Forest(size, 6, 5, every=True), "boosted": Boosted(rounds, 3, 0.03)}


def regression_metrics(df: DataFrame, label: str, guess: str = "guess", keys: list[str] | None = None) -> DataFrame:
    """(keys, rmse, mae, r2)."""
    y, e = F.col(label).cast("double"), F.col(label) - F.col(guess)
    return df.groupBy(*(keys or [])).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"))


def top_coefficients(spark, models: Linear, name: str, k: int = 15) -> DataFrame:
    """(feature, weight) of a binomial fit's largest weights, for columns in units of their deviation."""
    weights = zip(models.columns, map(float, models.weights[name][0] * models.units[name]), strict=True)
    return spark.createDataFrame(sorted(weights, key=lambda x: (-abs(x[1]), x[0]))[:k], "feature string, weight double")


def sampled(df: DataFrame, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """n rows by a hash of their keys: the same rows from run to run."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)
