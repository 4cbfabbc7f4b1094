"""Roster queries: expected roles, swaps, share shifts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftframe.operators import roster as R
from shiftframe.operators import transitions
from shiftframe.sources.tables import table

from . import views
from .catalog import query
from .domain import DIRICHLET
from .views import with_views

KEYS = ["season", "team_id"]


def _matrix(players):
    return transitions.dirichlet(transitions.transition_pairs(players))


def _model(players):
    """Stand-in model scores for two players in three, not scaled; some rows are all zeros, some lack a value."""
    k = F.col("player_id")
    raw = [F.when(k % 5 > 0, (k % (i + 3) + (1 if i < 2 else 0)).cast("double")).otherwise(0.0) for i in range(3)]
    raw[2] = F.when(k % 7 > 0, raw[2])
    return players.where("player_id % 3 > 0").select("player_id", *(raw[i].alias(f"m{i}") for i in range(3))).distinct()


# The model's row is taken whole or not at all; the matrix row is not scaled.
MODEL = """, md AS (SELECT DISTINCT player_id, CASE WHEN player_id % 5 > 0 THEN player_id % 3 + 1.0 ELSE 0 END::DOUBLE AS m0, CASE WHEN player_id % 5 > 0 THEN player_id % 4 + 1.0 ELSE 0 END::DOUBLE AS m1,
CASE WHEN player_id % 7 > 0 THEN CASE WHEN player_id % 5 > 0 THEN player_id % 5 + 0.0 ELSE 0 END END::DOUBLE AS m2 FROM v_ps WHERE player_id % 3 > 0),
wide AS (SELECT pos_group, from_cluster AS cluster, max(prob_mean) FILTER (WHERE to_cluster = 0) AS t0, max(prob_mean) FILTER (WHERE to_cluster = 1) AS t1, max(prob_mean) FILTER (WHERE to_cluster = 2) AS t2 FROM mx GROUP BY ALL),
raw AS (SELECT v.*, m0, m1, m2, m0 + m1 + m2 AS m, t0, t1, t2 FROM v_ps v LEFT JOIN md USING (player_id) LEFT JOIN wide USING (pos_group, cluster)),
pr AS (SELECT *, CASE WHEN m > 0 THEN m0 / m WHEN t0 IS NOT NULL THEN t0 ELSE 1.0::DOUBLE / 3 END AS p0, CASE WHEN m > 0 THEN m1 / m WHEN t0 IS NOT NULL THEN t1 ELSE 1.0::DOUBLE / 3 END AS p1,
CASE WHEN m > 0 THEN m2 / m WHEN t0 IS NOT NULL THEN t2 ELSE 1.0::DOUBLE / 3 END AS p2 FROM raw)"""


@query(with_views(DIRICHLET + ", s AS (SELECT season, team_id, v.pos_group, to_cluster AS cluster, sum(toi_es_sec * prob_mean) AS weight FROM v_ps v JOIN mx ON mx.pos_group = v.pos_group AND from_cluster = v.cluster GROUP BY ALL) SELECT season, team_id, pos_group, cluster, round(100 * weight / sum(weight) OVER (PARTITION BY season, team_id, pos_group), 2) AS share FROM s", "v_ps"))
def expected_composition(spark, sf_dir):
    players = views.player_seasons(spark, sf_dir)
    return R.expected_composition(players, _matrix(players), keys=KEYS).select(*KEYS, "pos_group", "cluster", "share")


@query(with_views(DIRICHLET + MODEL + ", s AS (SELECT season, team_id, pos_group, k AS cluster, sum(toi_es_sec * [p0, p1, p2][k + 1]) AS weight FROM pr, (SELECT unnest([0, 1, 2])::BIGINT AS k) GROUP BY ALL) SELECT season, team_id, pos_group, cluster, round(100 * weight / sum(weight) OVER (PARTITION BY season, team_id, pos_group), 2) AS share FROM s", "v_ps"))
def expected_composition_model(spark, sf_dir):
    players = views.player_seasons(spark, sf_dir)
    return R.expected_composition_model(players, _model(players), _matrix(players), keys=KEYS).select(*KEYS, "pos_group", "cluster", "share")


@query(with_views("SELECT pos_group, cluster, round(avg(cf60 - ca60), 6) AS net60 FROM v_ps GROUP BY ALL", "v_ps"))
def center_net60(spark, sf_dir):
    return R.center_net60(views.player_seasons(spark, sf_dir)).withColumn("net60", F.round("net60", 6))


@query(
    with_views(
        DIRICHLET + MODEL + """, cn AS (SELECT pos_group, max(n) FILTER (WHERE cluster = 0) AS c0, max(n) FILTER (WHERE cluster = 1) AS c1, max(n) FILTER (WHERE cluster = 2) AS c2 FROM (SELECT pos_group, cluster, avg(cf60 - ca60) AS n FROM v_ps GROUP BY ALL) GROUP BY ALL)
    SELECT season, team_id, pos_group, round(sum(toi_es_sec * (p0 * coalesce(c0, 0) + p1 * coalesce(c1, 0) + p2 * coalesce(c2, 0))) / sum(toi_es_sec), 6) AS net60 FROM pr JOIN cn USING (pos_group) GROUP BY ALL""",
        "v_ps",
    )
)
def expected_net60(spark, sf_dir):
    players = views.player_seasons(spark, sf_dir)
    return R.expected_net60(players, _model(players), _matrix(players), R.center_net60(players), keys=KEYS).withColumn("net60", F.round("net60", 6))


SWAP = """, ro AS (SELECT * FROM v_ps WHERE season = 19971998 AND team_id = 5), gone AS (SELECT min(player_id) AS player_id FROM ro),
af AS (SELECT season, player_id, team_id, pos_group, cluster, toi_es_sec FROM ro WHERE player_id NOT IN (SELECT player_id FROM gone) UNION ALL SELECT season, player_id, team_id, pos_group, cluster, toi_es_sec FROM v_ps WHERE season = 19971998 AND player_id = 11)"""


def _swap(spark, sf_dir):
    season = views.player_seasons(spark, sf_dir).where("season = 19971998")
    roster = season.where("team_id = 5").select("season", "player_id", "team_id", "pos_group", "cluster", "toi_es_sec")
    gone = roster.agg(F.min("player_id").alias("gone"))  # one row
    left = roster.join(F.broadcast(gone), F.col("player_id") == F.col("gone"), "left_anti")
    return roster, R.swapped(left, season, None, 11)


@query(with_views(SWAP + " SELECT * FROM af", "v_ps"))
def whatif_swap(spark, sf_dir):
    return _swap(spark, sf_dir)[1]


@query(
    with_views(
        SWAP + """, b AS (SELECT pos_group, cluster, round(100.0::DOUBLE * w / sum(w) OVER (PARTITION BY pos_group), 2) AS share FROM (SELECT pos_group, cluster, sum(toi_es_sec) AS w FROM ro GROUP BY ALL)),
    a AS (SELECT pos_group, cluster, round(100.0::DOUBLE * w / sum(w) OVER (PARTITION BY pos_group), 2) AS share FROM (SELECT pos_group, cluster, sum(toi_es_sec) AS w FROM af GROUP BY ALL))
    SELECT pos_group, cluster, coalesce(b.share, 0) AS before, coalesce(a.share, 0) AS after, round(coalesce(a.share, 0) - coalesce(b.share, 0), 2) AS delta FROM b FULL JOIN a USING (pos_group, cluster)""",
        "v_ps",
    )
)
def mix_delta(spark, sf_dir):
    before, after = _swap(spark, sf_dir)
    return R.mix_delta(R.composition(before), R.composition(after))


V3 = "SELECT event_id, value / 300 AS v0, (event_id % 10) / 30.0::DOUBLE AS v1, (event_id % 7) / 21.0::DOUBLE AS v2 FROM events"
# The steps one by one: held to 0..1, scaled to the total, moved (the donor is role 2, the third is role 1), held and scaled again.
STEPS = """c0 AS (SELECT *, least(1, v0) AS h0, least(1, v1) AS h1, least(1, v2) AS h2 FROM v3), c1 AS (SELECT *, h0 + h1 + h2 AS hs FROM c0),
c2 AS (SELECT *, CASE WHEN hs > 1e-12 THEN h0 * total / hs ELSE total / 3 END AS g0, CASE WHEN hs > 1e-12 THEN h1 * total / hs ELSE total / 3 END AS g1, CASE WHEN hs > 1e-12 THEN h2 * total / hs ELSE total / 3 END AS g2 FROM c1),
c3 AS (SELECT *, greatest(-g0, least(delta, total - g0)) AS m FROM c2), c4 AS (SELECT *, CASE WHEN m > 0 THEN least(g2, m) ELSE 0 END AS take1 FROM c3), c5 AS (SELECT *, CASE WHEN m - take1 > 1e-12 THEN least(g1, m - take1) ELSE 0 END AS take2 FROM c4),
c6 AS (SELECT *, CASE WHEN m > 0 THEN g0 + take1 + take2 ELSE g0 + m END AS w0, g1 - take2 AS w1, CASE WHEN m > 0 THEN g2 - take1 ELSE g2 - m END AS w2 FROM c5),
c7 AS (SELECT *, greatest(0, least(1, w0)) AS x0, greatest(0, least(1, w1)) AS x1, greatest(0, least(1, w2)) AS x2 FROM c6), c8 AS (SELECT *, x0 + x1 + x2 AS xs FROM c7),
s3 AS (SELECT *, CASE WHEN total < 1e-12 THEN 0 WHEN abs(m) < 1e-12 THEN g0 ELSE x0 * total / xs END AS s0, CASE WHEN total < 1e-12 THEN 0 WHEN abs(m) < 1e-12 THEN g1 ELSE x1 * total / xs END AS s1,
CASE WHEN total < 1e-12 THEN 0 WHEN abs(m) < 1e-12 THEN g2 ELSE x2 * total / xs END AS s2 FROM c8)"""


def _shares(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", (F.col("value") / 300).alias("v0"), ((k % 10) / 30.0).alias("v1"), ((k % 7) / 21.0).alias("v2"))


@query(f"WITH v3 AS (SELECT *, 0.9::DOUBLE AS total, CASE WHEN event_id % 2 = 0 THEN 0.1 ELSE -0.05 END::DOUBLE AS delta FROM ({V3})), {STEPS} SELECT event_id, round(s0, 10) AS s0, round(s1, 10) AS s1, round(s2, 10) AS s2 FROM s3")
def share_shift(spark, sf_dir):
    delta = F.when(F.col("event_id") % 2 == 0, 0.1).otherwise(-0.05)
    names = ["s0", "s1", "s2"]
    moved = R.with_shift(_shares(spark, sf_dir), ["v0", "v1", "v2"], F.lit(0.9), 0, delta, names)
    return moved.select("event_id", *(F.round(c, 10).alias(c) for c in names))


DELTAS = (-0.1, -0.05, -0.02, 0.0, 0.02, 0.05, 0.08, 0.1)
WEIGHTS, BIAS = {"v0": 0.8, "v1": -0.3, "v2": 0.1}, -0.2  # of a model that SQL can state; simulated_lineups fits its own
LOGIT = "1 / (1 + exp(-(0.8::DOUBLE * {0}0 - 0.3::DOUBLE * {0}1 + 0.1::DOUBLE * {0}2 - 0.2::DOUBLE)))"


@query(
    f"WITH v3 AS (SELECT *, v0 + v1 + v2 AS total FROM ({V3}), (SELECT unnest([{', '.join(map(str, DELTAS))}])::DOUBLE AS delta)), {STEPS} SELECT delta AS delta_share, round(avg({LOGIT.format('s')} - {LOGIT.format('v')}), 8) + 0.0 AS mean_change FROM s3 GROUP BY delta"
)
def sensitivity_grid(spark, sf_dir):
    grid = R.sensitivity_grid(_shares(spark, sf_dir), ["v0", "v1", "v2"], DELTAS, WEIGHTS, BIAS)
    return grid.select("delta_share", (F.round("mean_change", 8) + 0.0).alias("mean_change"))


PREDICTED = "SELECT event_id, event_id // 20 AS game_id, least(value, 100) / 100 AS p, CAST(event_type IN ('click', 'view') AS INT) AS y, (event_id % 100) / 100.0::DOUBLE AS s FROM events"


def _predicted(spark, sf_dir):
    y = F.col("event_type").isin("click", "view").cast("int")
    rows = table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 20").alias("game_id"), (F.least("value", F.lit(100.0)) / 100).alias("p"), y.alias("y"), ((F.col("event_id") % 100) / 100.0).alias("s"))
    return R.failures(rows, "p", "y", "s")


@query(f"SELECT event_id, p < 0.3 OR p > 0.7 AS confident, p > 0.48 AND p < 0.52 AS near_even, s > 0.55 AND y = 0 AS dominant_loss FROM ({PREDICTED}) WHERE CAST(p >= 0.5 AS INT) <> y")
def failure_cats(spark, sf_dir):
    return _predicted(spark, sf_dir).select("event_id", "confident", "near_even", "dominant_loss")


@query(
    f"""WITH f AS (SELECT * FROM ({PREDICTED}) WHERE CAST(p >= 0.5 AS INT) <> y), h AS (SELECT * FROM f WHERE p < 0.3 OR p > 0.7 ORDER BY p, event_id LIMIT 1),
    c AS (SELECT * FROM f WHERE p > 0.48 AND p < 0.52 AND game_id NOT IN (SELECT game_id FROM h) ORDER BY event_id LIMIT 1),
    d AS (SELECT * FROM f WHERE s > 0.55 AND y = 0 AND game_id NOT IN (SELECT game_id FROM h UNION ALL SELECT game_id FROM c) ORDER BY event_id LIMIT 1)
    SELECT 'High-Confidence Miss' AS category, event_id FROM h UNION ALL SELECT 'Close-Call Miss', event_id FROM c UNION ALL SELECT 'Possession-Dominant Loss', event_id FROM d"""
)
def failure_examples(spark, sf_dir):
    return R.failure_examples(_predicted(spark, sf_dir), "p", "game_id", ["event_id"]).select("category", "event_id")
