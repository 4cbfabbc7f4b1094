"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftframe.operators import buckets, features, grouping, ordering, totals
from shiftframe.sources.tables import table

from . import views
from .catalog import query
from .views import with_views


@query(with_views("SELECT season, player_id, CAST(sum(cf) AS BIGINT) AS cf, CAST(sum(ca) AS BIGINT) AS ca, CAST(count(*) AS BIGINT) AS games, min(cf) AS least, max(cf) AS most, round(avg(cf), 6) AS mean FROM v_pg GROUP BY season, player_id", "v_pg"))
def player_rollup(spark, sf_dir):
    cf = F.col("cf")
    return views.player_games(spark, sf_dir).groupBy("season", "player_id").agg(
        F.sum("cf").alias("cf"), F.sum("ca").alias("ca"), F.count("*").alias("games"), F.min(cf).alias("least"), F.max(cf).alias("most"), F.round(F.avg(cf), 6).alias("mean")
    )


@query(with_views("SELECT season, CAST(count(DISTINCT player_id) AS BIGINT) AS players, CAST(count(DISTINCT team_id) AS BIGINT) AS teams, CAST(count(DISTINCT game_id) AS BIGINT) AS games FROM v_pg GROUP BY season", "v_pg"))
def distinct_counts(spark, sf_dir):
    games = views.player_games(spark, sf_dir)
    return games.groupBy("season").agg(*(F.count_distinct(c).alias(n) for c, n in (("player_id", "players"), ("team_id", "teams"), ("game_id", "games"))))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"))
    return grouping.duplicate_keys(rows, ["l_orderkey", "line"])


@query(with_views("SELECT player_id, team_id, n FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY n DESC, team_id) AS k FROM (SELECT player_id, team_id, CAST(count(*) AS BIGINT) AS n FROM v_pg GROUP BY ALL)) WHERE k = 1", "v_pg"))
def mode_team(spark, sf_dir):
    return grouping.mode_by(views.player_games(spark, sf_dir), ["player_id"], "team_id")


@query(
    with_views(
        """, teams AS (SELECT season, player_id, team_id, CAST(sum(cf) AS BIGINT) AS cf, CAST(sum(ca) AS BIGINT) AS ca, CAST(sum(toi_es_sec) AS BIGINT) AS toi, count(DISTINCT game_id) AS games FROM v_pg GROUP BY ALL)
    SELECT season, player_id, arg_min(team_id, (-toi, team_id)) AS team_id, CAST(sum(cf) AS BIGINT) AS cf, CAST(sum(ca) AS BIGINT) AS ca, CAST(sum(games) AS BIGINT) AS game_count, count(DISTINCT team_id) > 1 AS multi_team,
    round(sum(cf) * 3600.0::DOUBLE / nullif(sum(toi), 0), 6) AS cf60 FROM teams GROUP BY season, player_id""",
        "v_pg",
    )
)
def primary_team(spark, sf_dir):
    return totals.aggregated_corsi(views.player_games(spark, sf_dir)).withColumn("cf60", F.round("cf60", 6))


@query(with_views("SELECT season, pos_group, round(coalesce(sum(cf60 * toi_es_sec) FILTER (WHERE toi_es_sec > 0) / nullif(sum(toi_es_sec) FILTER (WHERE toi_es_sec > 0), 0), 0.0), 6) AS cf60 FROM v_ps GROUP BY ALL", "v_ps"))
def weighted_mean(spark, sf_dir):
    mean = grouping.weighted_mean(F.col("cf60"), F.col("toi_es_sec"))
    return views.player_seasons(spark, sf_dir).groupBy("season", "pos_group").agg(F.round(mean, 6).alias("cf60"))


@query(with_views("SELECT season, team_id, pos_group, cluster, toi, round(100.0::DOUBLE * toi / sum(toi) OVER (PARTITION BY season, team_id, pos_group), 2) AS share FROM (SELECT season, team_id, pos_group, cluster, CAST(sum(toi_es_sec) AS BIGINT) AS toi FROM v_ps GROUP BY ALL)", "v_ps"))
def composition(spark, sf_dir):
    sums = views.player_seasons(spark, sf_dir).groupBy("season", "team_id", "pos_group", "cluster").agg(F.sum("toi_es_sec").alias("toi"))
    return grouping.shares(sums, "toi", ["season", "team_id", "pos_group"], "share")


@query(
    with_views(
        "SELECT season, " + ", ".join(f"round(coalesce(100.0::DOUBLE * count(*) FILTER (WHERE cluster = {k}) / count(*), 0), 6) AS c{k}" for k in range(3)) + " FROM v_ps GROUP BY season", "v_ps"
    )
)
def pivot_pct(spark, sf_dir):
    counts = views.player_seasons(spark, sf_dir).groupBy("season").pivot("cluster", [0, 1, 2]).count().na.fill(0)
    total = F.col("0") + F.col("1") + F.col("2")
    return counts.select("season", *(F.round(100.0 * F.col(str(k)) / total, 6).alias(f"c{k}") for k in range(3)))


EDGES = "SELECT quantile_cont(c_acctbal, [0, 0.25, 0.5, 0.75, 1]) AS e FROM customer"


@query(
    f"""SELECT CAST(bucket AS INT) AS bucket, CAST(count(*) AS BIGINT) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std
    FROM (SELECT c_acctbal, greatest(len(list_filter(e, lambda x: x < c_acctbal)) - 1, 0) AS bucket FROM customer, ({EDGES})) GROUP BY bucket"""
)
def bucket_stats(spark, sf_dir):
    cut = buckets.qcut(table(spark, sf_dir, "customer").select("c_acctbal"), "c_acctbal", 4, "bucket")
    return buckets.bucket_stats(cut, "bucket", "c_acctbal").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("SELECT c_nationkey, arg_min(c_name, c_custkey) AS first_name, min(c_custkey) AS first_key FROM customer GROUP BY c_nationkey")
def first_per_group(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min_by("c_name", "c_custkey").alias("first_name"), F.min("c_custkey").alias("first_key"))


NUMBERS = ("goals", "ca60", "es_share", "toi_per_game")


@query(with_views(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS corr FROM v_ps" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]), "v_ps"))
def corr_matrix(spark, sf_dir):
    return buckets.correlations(views.player_seasons(spark, sf_dir), list(NUMBERS)).withColumn("corr", F.round("corr", 6))


@query(with_views("SELECT pos_group, " + ", ".join(f"round(quantile_cont(cf60, {q}), 6) AS q{int(q * 100)}" for q in (0.5, 0.7, 0.8, 0.9, 0.95)) + " FROM v_ps GROUP BY pos_group", "v_ps"))
def quantiles(spark, sf_dir):
    points = (0.5, 0.7, 0.8, 0.9, 0.95)
    edges = ordering.quantile_edges(views.player_seasons(spark, sf_dir), "cf60", list(points), ["pos_group"])
    return edges.select("pos_group", *(F.round(F.col("edges")[k], 6).alias(f"q{int(q * 100)}") for k, q in enumerate(points)))


@query(with_views("SELECT cluster, round(avg(CAST(cf > ca AS INT)), 6) AS ahead, round(avg(CAST(goals > 100 AS INT)), 6) AS scoring FROM v_ps GROUP BY cluster", "v_ps"))
def empirical_rates(spark, sf_dir):
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return views.player_seasons(spark, sf_dir).groupBy("cluster").agg(rate(F.col("cf") > F.col("ca")).alias("ahead"), rate(F.col("goals") > 100).alias("scoring"))


@query("SELECT CAST(least(floor((value - 0) / 5.0), 19) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM events WHERE value >= 0 AND value <= 100 GROUP BY ALL")
def histogram(spark, sf_dir):
    return buckets.histogram(table(spark, sf_dir, "events"), "value", 0.0, 5.0, 20)


@query(with_views("SELECT DISTINCT season, team_id FROM v_pg", "v_pg"))
def distinct_rows(spark, sf_dir):
    return views.player_games(spark, sf_dir).select("season", "team_id").distinct()


_KINDS = (("goals", "Goal"), ("shots", "Shot"), ("missed_shots", "Missed Shot"), ("blocked_shots", "Blocked Shot"))


@query(
    with_views(
        ", "
        + ", ".join(
            f"{side} AS (SELECT game_id, team_id_{side} AS team_id, " + ", ".join(f"count(*) FILTER (WHERE event = '{e}') AS total_{n}_{side}" for n, e in _KINDS) + " FROM v_plays GROUP BY ALL)"
            for side in ("for", "against")
        )
        + " SELECT game_id, team_id, "
        + ", ".join(f"CAST(coalesce(total_{n}_{s}, 0) AS BIGINT) AS total_{n}_{s}" for s in ("for", "against") for n, _ in _KINDS)
        + " FROM \"for\" FULL JOIN against USING (game_id, team_id)",
        "v_plays",
    ).replace(" for AS (", ' "for" AS (')
)
def team_event_totals(spark, sf_dir):
    return totals.team_event_totals(views.plays(spark, sf_dir))


ROLE_SHARES = (
    "SELECT season, game_id, team_id, "
    + ", ".join(f"coalesce(sum(g.toi_es_sec) FILTER (WHERE pos_group = '{p}' AND cluster = {k}) / nullif(sum(g.toi_es_sec), 0), 0.0) AS {p}_share_{k}" for p in "FD" for k in range(3))
    + " FROM v_pg g LEFT JOIN (SELECT season, player_id, pos_group, cluster FROM v_ps WHERE games > 1) USING (season, player_id) GROUP BY season, game_id, team_id"
)


@query(with_views(f"SELECT season, game_id, team_id, {', '.join(f'round({c}, 6) AS {c}' for c in features.SHARES)} FROM ({ROLE_SHARES})", "v_ps"))
def toi_share_pivot(spark, sf_dir):
    """Each role's share of the team's time in a game; players of one game have no role."""
    roles = views.player_seasons(spark, sf_dir).where("games > 1")
    found = features.role_shares(views.player_games(spark, sf_dir), roles)
    return found.select("season", "game_id", "team_id", *(F.round(c, 6).alias(c) for c in features.SHARES))


@query(
    with_views(
        """, t AS (SELECT team, count(*) FILTER (WHERE side = 'f') AS cf, count(*) FILTER (WHERE side = 'a') AS ca FROM (SELECT team_id_for AS team, 'f' AS side, event FROM v_plays UNION ALL SELECT team_id_against, 'a', event FROM v_plays)
    WHERE event IN ('Shot', 'Missed Shot', 'Blocked Shot') GROUP BY team) SELECT team AS team_id, CAST(cf AS BIGINT) AS cf, CAST(ca AS BIGINT) AS ca, round(100.0::DOUBLE * cf / (cf + ca), 6) AS cf_percent FROM t""",
        "v_plays",
    )
)
def season_attempts(spark, sf_dir):
    return totals.season_attempts(views.plays(spark, sf_dir), goals=False).withColumn("cf_percent", F.round("cf_percent", 6))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT c_custkey FROM customer ORDER BY (c_custkey * 7919) % 104729, c_custkey LIMIT 50)")
def sample_rows(spark, sf_dir):
    """A fixed sample: the first rows by a hash of the key (here one that SQL shares)."""
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return people.orderBy((F.col("c_custkey") * 7919) % 104729, "c_custkey").limit(50)


@query()
def random_sample(spark, sf_dir):
    """Fifty rows by a seeded hash of the key: SQL has no such hash."""
    from shiftframe.operators.archetypes import sampled

    return sampled(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 50, ["c_custkey"], seed=42)
