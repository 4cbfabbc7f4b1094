"""Set operations, sorting and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shiftframe.sources.tables import table

from . import views
from .catalog import query
from .views import with_views


@query(with_views("SELECT game_id FROM v_shifts WHERE position = 'G' INTERSECT SELECT game_id FROM v_plays WHERE event = 'Goal'", "v_shifts", "v_plays"))
def common_games(spark, sf_dir):
    return views.shifts(spark, sf_dir).where("position = 'G'").select("game_id").intersect(views.plays(spark, sf_dir).where("event = 'Goal'").select("game_id"))


@query(with_views("SELECT game_id, player_id, 'shift_start' AS variable, shift_start AS value FROM v_shifts UNION ALL SELECT game_id, player_id, 'shift_end', shift_end FROM v_shifts", "v_shifts"))
def melt_series(spark, sf_dir):
    return views.shifts(spark, sf_dir).unpivot(["game_id", "player_id"], ["shift_start", "shift_end"], "variable", "value")


@query(
    """SELECT event_id, role, trim(who) AS player_raw FROM (
    SELECT event_id, 'p1' AS role, 'player ' || user_id AS who FROM events UNION ALL SELECT event_id, 'p2', CASE WHEN event_id % 3 = 0 THEN '  ' ELSE 'player ' || (user_id + 1) END FROM events
    UNION ALL SELECT event_id, 'p3', CASE WHEN event_id % 2 = 0 THEN 'player ' || (user_id + 2) END FROM events) WHERE trim(who) <> ''"""
)
def unpivot_roles(spark, sf_dir):
    from shiftframe.operators.boxscore import role_rows

    name = lambda k: F.concat(F.lit("player "), (F.col("user_id") + k).cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", name(0).alias("p1"), F.when(F.col("event_id") % 3 == 0, "  ").otherwise(name(1)).alias("p2"), F.when(F.col("event_id") % 2 == 0, name(2)).alias("p3"))
    return role_rows(rows, ["event_id"], ["p1", "p2", "p3"])


@query(with_views("SELECT player_id, season, cf FROM v_ps ORDER BY cf DESC, player_id, season LIMIT 25", "v_ps"))
def top_players(spark, sf_dir):
    return views.player_seasons(spark, sf_dir).select("player_id", "season", "cf").orderBy(F.desc("cf"), "player_id", "season").limit(25)


@query(with_views("SELECT player_id, team_id, cluster, toi_es_sec FROM v_ps WHERE season = 19971998 AND pos_group = 'F' AND player_id NOT IN (3, 5, 7) AND team_id <> 4 ORDER BY toi_es_sec DESC, player_id LIMIT 40", "v_ps"))
def add_candidates(spark, sf_dir):
    rows = views.player_seasons(spark, sf_dir).where((F.col("season") == 19971998) & (F.col("pos_group") == "F") & ~F.col("player_id").isin(3, 5, 7) & (F.col("team_id") != 4))
    return rows.select("player_id", "team_id", "cluster", "toi_es_sec").orderBy(F.desc("toi_es_sec"), "player_id").limit(40)


LOG = f""", cal AS (SELECT year(o_orderdate) * {views.YEAR} + o_orderkey // {views.ROUND} * {views.TEAMS} AS round, CAST(max(o_orderdate) AS DATE) AS day FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL),
log AS (SELECT g.game_id, g.player_id, g.cf, g.ca, c.day, CAST(row_number() OVER (PARTITION BY g.player_id ORDER BY c.day ASC NULLS LAST, g.game_id) AS INT) AS game_no
FROM (SELECT game_id, player_id, CAST(sum(cf) AS BIGINT) AS cf, CAST(sum(ca) AS BIGINT) AS ca FROM v_pg GROUP BY ALL) g LEFT JOIN cal c ON c.round = g.game_id - g.game_id % {views.TEAMS})"""


def _log(spark, sf_dir):
    games = views.player_games(spark, sf_dir).groupBy("game_id", "player_id").agg(F.sum("cf").alias("cf"), F.sum("ca").alias("ca"))
    days = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy(views.first_game("o_orderdate", "o_orderkey").alias("round")).agg(F.to_date(F.max("o_orderdate")).alias("day"))
    order = Window.partitionBy("player_id").orderBy(F.asc_nulls_last("day"), "game_id")
    dated = games.withColumn("round", F.col("game_id") - F.col("game_id") % views.TEAMS).join(days, "round", "left").drop("round")
    return dated.withColumn("game_no", F.row_number().over(order))


@query(with_views(LOG + " SELECT * FROM log", "v_pg"))
def gamelog(spark, sf_dir):
    return _log(spark, sf_dir)


@query(with_views(LOG + ", f AS (SELECT player_id, min(game_no) AS focus FROM log WHERE cf >= 60 GROUP BY ALL) SELECT log.* FROM log JOIN f USING (player_id) WHERE game_no BETWEEN greatest(1, focus - 3) AND focus + 3", "v_pg"))
def focus_window(spark, sf_dir):
    log = _log(spark, sf_dir)
    focus = log.where("cf >= 60").groupBy("player_id").agg(F.min("game_no").alias("focus"))
    near = log.join(focus, "player_id").where(F.col("game_no").between(F.greatest(F.lit(1), F.col("focus") - 3), F.col("focus") + 3))
    return near.select("game_id", "player_id", "cf", "ca", "day", "game_no")


@query(
    with_views(
        """, s AS (SELECT player_id, sum(cf) AS cf FROM v_ps GROUP BY ALL) SELECT player_id, CAST(cf AS BIGINT) AS cf, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY cf DESC, player_id) AS rank FROM s) WHERE rank <= 10""",
        "v_ps",
    )
)
def ranked_top(spark, sf_dir):
    """Top rows first, then their ranks: only the ten are numbered in one task."""
    sums = views.player_seasons(spark, sf_dir).groupBy("player_id").agg(F.sum("cf").alias("cf"))
    top = sums.orderBy(F.desc("cf"), "player_id").limit(10)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cf"), "player_id")))
