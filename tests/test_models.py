"""Fits: every query without SQL gives its rows, and the operators find what was put into the data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftframe.operators import archetypes as A
from shiftframe.plans import catalog, models, views

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


def rows_of(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def test_archetypes(spark):
    players = views.player_seasons(spark, FOLDER).drop("cluster")
    model = A.kmeans(players, models.FEATURES, seeds=range(42, 46), order_by="toi_per_game")
    found = A.assigned(model, players)
    means = [r.m for r in found.groupBy("cluster").agg(F.avg("toi_per_game").alias("m")).orderBy("cluster").collect()]
    assert means == sorted(means) and A.centers(model, players).count() == 3
    players_in = players.count()
    assert {r.cluster for r in rows_of(spark, "kmeans_archetypes")} <= {0, 1, 2} and len(rows_of(spark, "kmeans_archetypes")) == players_in
    assert len(rows_of(spark, "pca_boundary")) == players_in


def test_all_restarts_cost_no_more_than_single_fits(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    from shiftframe.operators import clusters

    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(150, 3)) + c for c in ([0, 0, 0], [6, 0, 1], [0, 7, 0], [5, 5, 5])]) * [1, 10, 0.1]
    rows = spark.createDataFrame([tuple(map(float, p)) for p in points] + [(None, 1.0, 1.0)], "a double, b double, c double").repartition(4)
    vectors = clusters.vectors_of(rows, ["a", "b", "c"], True)[0].select(array_to_vector("x").alias("x")).persist()
    found = clusters.kmeans_runs(rows, ["a", "b", "c"], [(k, s) for k in (2, 4) for s in range(6)])
    shape = clusters.silhouettes(rows, ["a", "b", "c"], found)
    for k in (2, 4):
        single = min((KMeans(k=k, seed=s, featuresCol="x").fit(vectors) for s in range(6)), key=lambda m: m.summary.trainingCost)
        best = min((r for r in found if r[0] == k), key=lambda r: found[r][0].cost)
        assert found[best][0].cost <= single.summary.trainingCost * 1.0001
        if k == 4:
            assert shape[best] == pytest.approx(ClusteringEvaluator(featuresCol="x").evaluate(single.transform(vectors)), abs=1e-3)
            assert found[best][1][:, 0].sum() == 600 and found[best][1][:, 0].min() > 140 and A.assigned(found[best][0], rows).count() == 600
    again = clusters.kmeans_runs(rows.repartition(7), ["a", "b", "c"], [(4, 1)])
    assert np.allclose(again[4, 1][0].centres, found[4, 1][0].centres)


def test_a_step_of_all_restarts_is_one_job(spark):
    from shiftframe.operators import clusters

    vectors = spark.range(8, numPartitions=4).select("id", F.array((F.col("id") % 2).cast("double")).alias("x")).persist()
    vectors.count()
    spark.sparkContext.setJobGroup("one step", "")
    try:
        found = clusters.lloyd(vectors, {(2, s): np.array([[0.0], [1.0]]) for s in range(3)}, 1)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("one step")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        vectors.unpersist()
    assert len(jobs) == 1 and all(cost == 0 and sums[:, 0].tolist() == [4, 4] for _, cost, sums in found.values())


@pytest.mark.parametrize("name", ["kmeans_archetypes", "pca_boundary"])
def test_players_are_computed_once(spark, name):
    assert "lineitem" not in QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()


def test_sweep(spark):
    found = sorted(rows_of(spark, "kmeans_sweep"), key=lambda r: r.k)
    assert [r.k for r in found] == list(range(2, 9)) and found[0].inertia > found[-1].inertia and all(-1 <= r.silhouette <= 1 for r in found)


@pytest.mark.parametrize("scale", [True, False])
def test_role_model_learns(spark, scale):
    rows = spark.createDataFrame([(20182019 + 10001 * (k % 3), k, "FD"[k % 2], float(k % 7), float(k % 7 // 3)) for k in range(600)], "season long, player_id long, pos_group string, x1 double, y double")
    found = A.expanding_probabilities(rows, ["x1"], "y", scale=scale, group="pos_group")
    assert {(r.pos_group, r.season) for r in found.select("pos_group", "season").distinct().collect()} == {(p, s) for p in "FD" for s in (20192020, 20202021)}
    for m in A.class_metrics(found, "y", keys=["pos_group", "season"]).collect():
        assert m.accuracy > 0.9 > m.baseline and m.n == 100
    gated = A.expanding_probabilities(rows, ["x1"], "y", scale=scale, group="pos_group", gates={"F": (150, 50), "D": (80, 101)})
    assert {(r.pos_group, r.season) for r in gated.select("pos_group", "season").distinct().collect()} == {("F", 20202021)}
    assert A.expanding_probabilities(rows, ["x1"], "y", scale=scale, gates={"": (1000, 1)}) is None


def test_a_label_that_training_lacks_gets_nothing(spark):
    rows = spark.createDataFrame([(20182019 + 10001 * (k // 50), k, float(k % 2), float(k % 2)) for k in range(100)], "season long, player_id long, x1 double, y double")
    found = A.expanding_probabilities(rows, ["x1"], "y").first()
    assert found.p_to2 == 0 and found.p_to0 + found.p_to1 == pytest.approx(1)


def test_probabilities(spark):
    for name in ("multinomial_probs", "multinomial_unscaled"):
        for r in rows_of(spark, name):
            assert r.p_to0 + r.p_to1 + r.p_to2 == pytest.approx(1)
    found = rows_of(spark, "multinomial_summary")
    assert found and all(0 <= r.accuracy <= 1 and 0 <= r.baseline <= 1 and math.isfinite(r.log_loss) for r in found)
    assert len({r.season_t for r in rows_of(spark, "multinomial_unscaled")}) >= 4  # all seasons that have one before them


def test_probabilities_compute_the_pairs_once(spark, monkeypatch):
    """Their columns have no lineage left when conditions are put on them."""
    given = []
    monkeypatch.setattr(models.A, "expanding_probabilities", lambda df, *args, **kwargs: given.append(df))  # gives None: no rows
    for name in ("multinomial_probs", "multinomial_unscaled"):
        QUERIES[name](spark, FOLDER)
    for df in given:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation" not in plan and "Join" not in plan and "Aggregate" not in plan


def test_players_rows_are_read_once_each(spark):
    """A season's main team needs no second pass, and teams' sums no row for each player's game between."""
    tables = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation")
    assert tables(views.player_seasons(spark, FOLDER)) == 2
    assert tables(QUERIES["team_game_features"](spark, FOLDER)) == 8  # lineitem and orders for a game's two sides, role seconds and roles


def test_simulated_lineups_compute_the_games_once(spark):
    found = QUERIES["simulated_lineups"](spark, FOLDER)
    assert "Relation" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_fits_make_a_teams_sums_once(spark):
    """The same rows as of ``team_game_features``, without a second pass for the opponents' sums."""
    games = models._games(spark, FOLDER)
    assert games._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 6
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    plain = models.features.model_table(views.player_rows(spark, FOLDER), views.player_seasons(spark, FOLDER))
    assert games.columns == plain.columns and rounded(games) == rounded(plain)


def test_complete_leaves_nulls_and_nans_out(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (None, 4.0)], "a long, b double")
    assert [r.a for r in models.folded.complete(rows, ["a", "b"]).collect()] == [1]


def test_penalties_count_the_training_rows(spark):
    """Twice the same rows and the same weight of the penalty against each: the same fit."""
    from pyspark.ml import Pipeline

    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(float(x), float(x + rng.normal() > 0)) for x in rng.normal(size=200)], "x1 double, y double")
    weight = lambda df, make: float(Pipeline(stages=[*A.plain(["x1"]), make("y", df.count())]).fit(df).stages[-1].coefficients[0])
    assert weight(rows, A.logistic(0.1)) == pytest.approx(weight(rows.unionByName(rows), A.logistic(0.05)), rel=1e-3)
    assert weight(rows, A.regressors()["ridge"][0]) == pytest.approx(weight(rows.unionByName(rows), A.regressors(alpha=2.0)["ridge"][0]), rel=1e-3)


def test_metrics(spark):
    rows = spark.createDataFrame([(0.1, 0.0), (0.4, 0.0), (0.4, 1.0), (0.8, 1.0)], "p double, y double")
    m = A.binary_metrics(rows, "p", "y").first()
    assert m.auc == pytest.approx(3.5 / 4) and m.brier == pytest.approx((0.01 + 0.16 + 0.36 + 0.04) / 4) and m.accuracy == pytest.approx(0.75)
    report = {r.label: r for r in A.class_report(spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y int, p int"), "y", "p").collect()}
    assert report[0].recall == 0.5 and report[0].precision == 1 and report[1].precision == 0.5 and report[2].f1 == 0 == report[2].support
    r = A.regression_metrics(spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "y double, guess double"), "y").first()
    assert r.rmse == pytest.approx(math.sqrt(0.5)) and r.mae == 0.5 and r.r2 == pytest.approx(0.5)


def test_model_table(spark):
    """Two teams, seven games: rolled means see earlier games only, and the label is the goals'."""
    from shiftframe.operators import features

    columns = ["season", "game_id", "player_id", "team_id", *features.SUMS]
    def row(g, t, goals, seconds, player):
        return (1, g, player, t, *(goals if c == "goals" else seconds if c.startswith("toi") else 10 + g if c == "cf" else 5 if c in ("ca", "faceoff_taken") else 1 for c in features.SUMS))
    data = [row(g, t, (g + t) % 2, 600, 10 * t) for g in range(7) for t in (1, 2)] + [row(g, 1, 0, 200, 11) for g in range(7)]
    games = spark.createDataFrame(data, columns)
    roles = spark.createDataFrame([(1, 10, "F", 0), (1, 20, "D", 2)], "season long, player_id long, pos_group string, cluster int")
    found = {(r.game_id, r.team_id): r for r in features.model_table(games, roles).collect()}
    assert set(found) == {(g, t) for g in (5, 6) for t in (1, 2)}
    assert found[6, 1].win == 1 and found[6, 1].goal_diff == 1 and found[6, 2].win == 0
    assert found[6, 1].roll15_F_share_0 == pytest.approx(0.75) and found[6, 2].roll15_D_share_2 == 1 and found[6, 2].roll15_F_share_0 == 0
    assert found[6, 2].roll15_cf_percent == pytest.approx(np.mean([(10 + g) / (15 + g) for g in range(6)]))
    assert found[6, 1].roll15_shots == 2 and found[6, 1].roll15_diff_cf60 == pytest.approx(np.mean([(20 + 2 * g) * 4.5 - (10 + g) * 6 for g in range(6)]))


def test_no_group_is_in_two_folds(spark):
    rows = spark.createDataFrame([(k // 4, float(k % 5), float(k % 5 > 2)) for k in range(400)], "g long, x1 double, y double")
    found = A.cross_validated(rows, ["x1"], "y", "g", A.logistic(10.0))
    assert found.count() == 400 and found.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert A.binary_metrics(found, "prob", "y").first().auc > 0.99


def test_grid():
    assert len(A.grid()) == 4 + 12 + 18


def test_tree_queries_have_their_whole_size(spark, monkeypatch):
    from contextlib import nullcontext

    seen = []
    monkeypatch.setattr(A, "grid_search", lambda games, columns, label, group, points: seen.append(points))
    QUERIES["grid_search"](spark, FOLDER)
    assert seen == [A.grid()] and {p.trees for p in seen[0].values() if hasattr(p, "trees")} == {300, 600} and {p.rounds for p in seen[0].values() if hasattr(p, "rounds")} == {200, 400}

    def cross_scored(games, columns, label, points, **options):
        seen.append(points)
        raise InterruptedError

    monkeypatch.setattr(models.folded, "kept_folds", lambda *a: nullcontext())
    monkeypatch.setattr(models.folded, "ridge_scored", lambda *a: None)
    monkeypatch.setattr(models.trees, "cross_scored", cross_scored)
    with pytest.raises(InterruptedError):
        QUERIES["goal_regression"](spark, FOLDER)
    assert seen[1]["forest"].trees == 600 and seen[1]["forest"].every and seen[1]["boosted"].rounds == 200


def test_scores(spark):
    assert rows_of(spark, "cv_metrics")[0].auc_mean > 0.5
    assert 0 <= rows_of(spark, "temporal_holdout")[0].auc <= 1
    assert {r.model for r in rows_of(spark, "goal_regression")} == {"ridge", "forest", "boosted"}
    assert {r.features for r in rows_of(spark, "ablation")} == {"all", "without shares"}
    assert len(rows_of(spark, "grid_search")) == 34
    assert sum(r.n for r in rows_of(spark, "calibration_oof")) == models._games(spark, FOLDER).count()
    assert len(rows_of(spark, "top_coefficients")) == 15
    found = {r.delta_share: r.mean_change for r in rows_of(spark, "simulated_lineups")}
    assert len(found) == 8 and found[0.0] == pytest.approx(0, abs=1e-9)
