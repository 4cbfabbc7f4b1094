"""Window functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shiftframe.operators import buckets, features, grouping, lines
from shiftframe.sources.tables import table

from . import views
from .catalog import query
from .views import with_views


@query(with_views("SELECT player_id, cluster, n FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY n DESC, cluster) AS k FROM (SELECT player_id, cluster, CAST(count(*) AS BIGINT) AS n FROM v_ps GROUP BY ALL)) WHERE k = 1", "v_ps"))
def most_common_cluster(spark, sf_dir):
    return grouping.mode_by(views.player_seasons(spark, sf_dir), ["player_id"], "cluster")


@query(with_views("SELECT player_id, CAST(count(*) AS BIGINT) AS seasons, CAST(count(*) FILTER (WHERE p IS NOT NULL AND p <> cluster) AS BIGINT) AS changes, round(avg(CAST(p <> cluster AS INT)) FILTER (WHERE p IS NOT NULL), 6) AS rate FROM (SELECT player_id, cluster, lag(cluster) OVER (PARTITION BY player_id ORDER BY season) AS p FROM v_ps) GROUP BY player_id", "v_ps"))
def transition_rate(spark, sf_dir):
    before = F.lag("cluster").over(Window.partitionBy("player_id").orderBy("season"))
    rows = views.player_seasons(spark, sf_dir).select("player_id", (before != F.col("cluster")).alias("moved"))
    return rows.groupBy("player_id").agg(F.count("*").alias("seasons"), F.count_if("moved").alias("changes"), F.round(F.avg(F.col("moved").cast("int")), 6).alias("rate"))


ROLL = ", tg AS (SELECT season, team_id, game_id, CAST(sum(cf) AS BIGINT) AS cf FROM v_pg GROUP BY ALL)"


def _team_games(spark, sf_dir):
    return views.player_games(spark, sf_dir).groupBy("season", "team_id", "game_id").agg(F.sum("cf").alias("cf"))


@query(with_views(ROLL + " SELECT season, team_id, game_id, CASE WHEN count(cf) OVER w >= 5 THEN round(avg(cf) OVER w, 6) END AS roll15_cf FROM tg WINDOW w AS (PARTITION BY season, team_id ORDER BY game_id ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)", "v_pg"))
def rolling15_grouped(spark, sf_dir):
    rows = features.rolling_mean(_team_games(spark, sf_dir), "cf", "roll15_cf", [F.col("game_id")], ["season", "team_id"])
    return rows.select("season", "team_id", "game_id", F.round("roll15_cf", 6).alias("roll15_cf"))


@query(with_views(ROLL + ", s AS (SELECT *, lag(cf) OVER (PARTITION BY season, team_id ORDER BY game_id) AS v FROM tg) SELECT season, team_id, game_id, CASE WHEN count(v) OVER w >= 5 THEN round(avg(v) OVER w, 6) END AS roll15_cf FROM s WINDOW w AS (ORDER BY season, team_id, game_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)", "v_pg"))
def rolling15_flat(spark, sf_dir):
    rows = features.rolling_mean_flat(_team_games(spark, sf_dir), "cf", "roll15_cf", [F.col("game_id")], ["season", "team_id"])
    return rows.select("season", "team_id", "game_id", F.round("roll15_cf", 6).alias("roll15_cf"))


@query(with_views(ROLL + " SELECT season, team_id, game_id, round(avg(cf) OVER (PARTITION BY season, team_id ORDER BY game_id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 6) AS trend FROM tg", "v_pg"))
def centered_rolling(spark, sf_dir):
    n = 10
    w = Window.partitionBy("season", "team_id").orderBy("game_id").rowsBetween(-(n // 2), (n - 1) // 2)
    return _team_games(spark, sf_dir).select("season", "team_id", "game_id", F.round(F.avg("cf").over(w), 6).alias("trend"))


@query(with_views("SELECT season, player_id, round(toi_es_sec / sum(toi_es_sec) OVER (PARTITION BY season), 8) AS share FROM v_ps", "v_ps"))
def share_in_group(spark, sf_dir):
    return views.player_seasons(spark, sf_dir).select("season", "player_id", F.round(buckets.share_over(F.col("toi_es_sec"), ["season"]), 8).alias("share"))


@query(with_views("SELECT season, team_id, player_id, CAST(k AS INT) AS rank, CAST((k - 1) // 3 + 1 AS INT) AS line FROM (SELECT *, row_number() OVER (PARTITION BY season, team_id ORDER BY toi_es_sec DESC, player_id) AS k FROM v_ps WHERE pos_group = 'F') WHERE k <= 12", "v_ps"))
def line_assign(spark, sf_dir):
    return lines.assign_lines(views.player_seasons(spark, sf_dir).where("pos_group = 'F'")).select("season", "team_id", "player_id", "rank", "line")


@query(
    """SELECT c_custkey, 'Q' || (bucket + 1) AS quartile, printf('$%.2f', c_acctbal) AS label
    FROM (SELECT c_custkey, c_acctbal, greatest(len(list_filter(e, lambda x: x < c_acctbal)) - 1, 0) AS bucket FROM customer, (SELECT quantile_cont(c_acctbal, [0, 0.25, 0.5, 0.75, 1]) AS e FROM customer))"""
)
def qcut_buckets(spark, sf_dir):
    cut = buckets.qcut(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 4, "bucket")
    return cut.select("c_custkey", F.concat(F.lit("Q"), (F.col("bucket") + 1).cast("string")).alias("quartile"), F.format_string("$%.2f", "c_acctbal").alias("label"))


@query(
    """SELECT CAST(bin AS INT) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(hit), 6) AS mean, round(stddev_samp(hit) / sqrt(count(*)), 6) AS se
    FROM (SELECT CAST(event_type = 'click' AS INT) AS hit, greatest(len(list_filter(e, lambda x: x < v)) - 1, 0) AS bin
      FROM (SELECT event_type, floor(value / 10) AS v FROM events), (SELECT list_distinct(quantile_cont(floor(value / 10), [k / 20.0::DOUBLE for k in range(21)])) AS e FROM events)) GROUP BY bin""".replace(
        "[k / 20.0::DOUBLE for k in range(21)]", "[" + ", ".join(str(k / 20) for k in range(21)) + "]"
    )
)
def calib_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("event_type") == "click").cast("int").alias("hit"), F.floor(F.col("value") / 10).cast("double").alias("v"))
    cut = buckets.qcut(rows, "v", 20, "bin", distinct=True)
    return cut.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("mean"), F.round(F.stddev_samp("hit") / F.sqrt(F.count("*")), 6).alias("se"))


@query(
    """SELECT l_orderkey, l_linenumber || CASE WHEN k = 1 THEN '' WHEN k <= 26 THEN chr(CAST(96 + k AS INT)) ELSE chr(CAST(96 + (k - 1) // 26 AS INT)) || chr(CAST(97 + (k - 1) % 26 AS INT)) END AS play_id
    FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS k FROM lineitem)"""
)
def dedupe_suffix(spark, sf_dir):
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    suffix = grouping.duplicate_suffix(F.row_number().over(order))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.col("l_linenumber").cast("string"), suffix).alias("play_id"))
