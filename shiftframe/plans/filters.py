"""Filters and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftframe.sources.tables import table

from . import views
from .catalog import query
from .views import with_views


@query(with_views("SELECT * FROM v_shifts WHERE shift_end > shift_start AND shift_start BETWEEN 600 AND 3000 AND team_id = 1", "v_shifts"))
def filter_range(spark, sf_dir):
    return views.shifts(spark, sf_dir).where((F.col("shift_end") > F.col("shift_start")) & F.col("shift_start").between(600, 3000) & (F.col("team_id") == 1))


@query(with_views("SELECT * FROM v_plays WHERE event IN ('Goal', 'Shot') AND team_id_for NOT IN (0) AND list_contains([0, 2], time // 1200)", "v_plays"))
def in_list(spark, sf_dir):
    period = F.array_contains(F.array(*map(F.lit, (0, 2))), F.expr("int(time div 1200)"))
    return views.plays(spark, sf_dir).where(F.col("event").isin("Goal", "Shot") & ~F.col("team_id_for").isin(0) & period)


@query(with_views("SELECT player_id, CAST(count(*) AS BIGINT) AS games FROM v_pg WHERE season = 19971998 GROUP BY player_id HAVING count(*) >= 82 * 0.32", "v_pg"))
def having_threshold(spark, sf_dir):
    games = views.player_games(spark, sf_dir, 19971998, 19971998)
    return games.groupBy("player_id").agg(F.count("*").alias("games")).where(F.expr("games >= 82 * 0.32"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'RED%g%' OR contains(lower(p_brand), 'and#1')")
def ilike_filter(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where(F.col("p_name").ilike("RED%g%") | F.contains(F.lower("p_brand"), F.lit("and#1"))).select("p_partkey", "p_name")


@query(
    """SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE k IS NULL) AS BIGINT) AS n_null, CAST(count(*) FILTER (WHERE isnan(v)) AS BIGINT) AS n_nan,
    CAST(sum(CAST(value > 50 AS INT)) AS BIGINT) AS n_high FROM (SELECT *, CASE WHEN event_id % 7 > 0 THEN json_extract_string(props, '$.k') END AS k,
    CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE value END AS v FROM events) GROUP BY event_type"""
)
def null_nan_profile(spark, sf_dir):
    k = F.when(F.col("event_id") % 7 > 0, F.get_json_object("props", "$.k"))
    v = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").withColumns({"k": k, "v": v})
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("k").isNull()).alias("n_null"), F.count_if(F.isnan("v")).alias("n_nan"), F.sum((F.col("value") > 50).cast("long")).alias("n_high")
    )


@query(
    with_views(
        """SELECT season, player_id, CASE WHEN season = (SELECT max(season) FROM v_ps) THEN 'test' ELSE 'train' END AS part FROM v_ps WHERE season <= (SELECT max(season) FROM v_ps)""",
        "v_ps",
    )
)
def season_split(spark, sf_dir):
    from shiftframe.operators.transitions import season_parts

    return season_parts(views.player_seasons(spark, sf_dir)).select("season", "player_id", "part")
