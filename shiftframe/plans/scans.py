"""Scans, projections and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftframe.functions import clock, parse, rates
from shiftframe.functions.seasons import season_of_year
from shiftframe.sources.html import link_texts, links, title
from shiftframe.sources.tables import table

from . import views
from .catalog import query
from .views import with_views


@query("SELECT o_orderkey AS game_id, o_custkey AS player_id, CAST(o_totalprice AS DOUBLE) AS price, CAST(o_orderdate AS DATE) AS day, 'R' AS session FROM orders")
def scan_project(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("game_id"), F.col("o_custkey").alias("player_id"), F.col("o_totalprice").alias("price"), F.to_date("o_orderdate").alias("day"), F.lit("R").alias("session")
    )


@query(
    """SELECT page_id, nullif(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '') AS title,
    CAST(len(regexp_extract_all(html, '<a\\s[^>]*>')) AS BIGINT) AS n_links, CAST(length(html) AS BIGINT) AS n_chars FROM pages"""
)
def html_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", title(F.col("html")).alias("title"), F.size(link_texts(F.col("html"))).cast("long").alias("n_links"), F.length("html").cast("long").alias("n_chars"))


@query(
    """SELECT page_id, regexp_extract(x, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(x, '<[^>]+>', '', 'g')) AS text, CAST(count(*) AS BIGINT) AS n
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a\\s[^>]*href="([^"]*)"[^>]*>.*?</a>')) AS x FROM pages) GROUP BY ALL"""
)
def page_links(spark, sf_dir):
    """Every link of every page with its text."""
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(links(F.col("html"))).alias("x"))
    return found.groupBy("page_id", "x.href", "x.text").agg(F.count("*").alias("n"))


@query(with_views("SELECT season, CAST(count(*) AS BIGINT) AS n, CAST(sum(cf) AS BIGINT) AS cf FROM v_pg WHERE season IN (19961997, 19971998, 19981999) GROUP BY season", "v_pg"))
def union_seasons(spark, sf_dir):
    """The union of some seasons' tables is one read of the table that holds all, by a range of days."""
    return views.player_games(spark, sf_dir, 19961997, 19981999).groupBy("season").agg(F.count("*").alias("n"), F.sum("cf").alias("cf"))


@query(with_views("SELECT game_id, event, CAST(count(*) AS BIGINT) AS n, CAST(sum(shift_len) AS BIGINT) AS seconds FROM (SELECT game_id, event, NULL AS shift_len FROM v_plays UNION ALL SELECT game_id, NULL, shift_end - shift_start FROM v_shifts) GROUP BY ALL", "v_plays", "v_shifts"))
def union_frames(spark, sf_dir):
    shifts = views.shifts(spark, sf_dir).select("game_id", (F.col("shift_end") - F.col("shift_start")).alias("shift_len"))
    both = views.plays(spark, sf_dir).select("game_id", "event").unionByName(shifts, allowMissingColumns=True)
    return both.groupBy("game_id", "event").agg(F.count("*").alias("n"), F.sum("shift_len").alias("seconds"))


@query(with_views("SELECT * FROM v_shifts WHERE game_id IN (SELECT game_id FROM v_plays WHERE event = 'Goal') AND shift_end > shift_start", "v_shifts", "v_plays"))
def semi_games(spark, sf_dir):
    goals = views.plays(spark, sf_dir).where("event = 'Goal'").select("game_id")
    return views.shifts(spark, sf_dir).where("shift_end > shift_start").join(goals, "game_id", "left_semi")


@query(with_views("SELECT game_id, CAST(count(*) AS BIGINT) AS events, CAST(count(event) AS BIGINT) AS attempts, min(time) AS first_time, max(time) AS last_time FROM v_plays GROUP BY game_id", "v_plays"))
def ctas_like(spark, sf_dir):
    return views.plays(spark, sf_dir).groupBy("game_id").agg(F.count("*").alias("events"), F.count("event").alias("attempts"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


@query(
    """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, trim(event_type) AS event_type, TRY_CAST(json_extract_string(props, '$.x') AS DOUBLE) AS x
    FROM events WHERE value IS NOT NULL"""
)
def clean_cast(spark, sf_dir):
    events = table(spark, sf_dir, "events").dropna(subset=["value"])
    prop = lambda n: F.get_json_object("props", f"$.{n}")
    return events.select("event_id", parse.clean_number(prop("k")).alias("k"), F.trim("event_type").alias("event_type"), parse.clean_number(prop("x"), "double", None).alias("x"))


@query(
    """SELECT event_id, CASE WHEN p BETWEEN 1 AND 3 THEN (p - 1) * 1200 + s ELSE 3600 + s END AS seconds, (p - 1) * 1200 + s AS legacy
    FROM (SELECT event_id, event_id % 5 + 1 AS p, event_id * 7 % 1200 AS s FROM events)"""
)
def game_clock(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 5 + 1).alias("p"), (F.col("event_id") * 7 % 1200).alias("s"))
    return events.select("event_id", clock.game_seconds(F.col("p"), F.col("s")).alias("seconds"), clock.legacy_seconds(F.col("p"), F.col("s")).alias("legacy"))


@query(with_views("SELECT event_id, event, team_id_for FROM v_plays", "v_plays"))
def event_map(spark, sf_dir):
    return views.plays(spark, sf_dir).select("event_id", "event", "team_id_for")


LABELS = {"F": {0: "Two-way", 1: "Depth", 2: "Scoring"}, "D": {0: "Shutdown", 1: "Balanced"}}


@query(
    with_views(
        """SELECT season, player_id, pos_group, CASE WHEN pos_group = 'F' THEN CASE cluster WHEN 0 THEN 'Two-way' WHEN 1 THEN 'Depth' WHEN 2 THEN 'Scoring' END
    ELSE CASE cluster WHEN 0 THEN 'Shutdown' WHEN 1 THEN 'Balanced' ELSE CAST(cluster AS VARCHAR) END END AS label FROM v_ps""",
        "v_ps",
    )
)
def cluster_label(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for pos, own in LABELS.items() for k, v in own.items() for x in (f"{pos}{k}", v)))
    label = F.coalesce(F.try_element_at(names, F.concat("pos_group", F.col("cluster").cast("string"))), F.col("cluster").cast("string"))
    return views.player_seasons(spark, sf_dir).select("season", "player_id", "pos_group", label.alias("label"))


@query(
    """SELECT event_id, coalesce(k, 0.5) AS filled, round(coalesce(k, avg(k) OVER ()), 6) AS imputed
    FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM events)"""
)
def impute(spark, sf_dir):
    k = F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").try_cast("double"))
    rows = table(spark, sf_dir, "events").select("event_id", k.alias("k"))
    mean = rows.agg(F.avg("k").alias("mean"))  # one row, joined instead of a window over everything
    return rows.join(F.broadcast(mean)).select("event_id", F.coalesce("k", F.lit(0.5)).alias("filled"), F.round(F.coalesce("k", "mean"), 6).alias("imputed"))


@query(
    with_views(
        """SELECT season, game_id, player_id, team_id, round(cf * 3600.0::DOUBLE / nullif(toi_es_sec, 0), 6) AS cf60, round(ca * 3600.0::DOUBLE / nullif(toi_es_sec, 0), 6) AS ca60,
    round(100.0::DOUBLE * cf / nullif(cf + ca, 0), 6) AS cf_percent, round(coalesce(goals / nullif(hits, 0), 0), 6) AS goals_per_hit FROM v_pg""",
        "v_pg",
    )
)
def safe_rates(spark, sf_dir):
    cf, ca, toi = F.col("cf"), F.col("ca"), F.col("toi_es_sec")
    found = {"cf60": rates.per60(cf, toi), "ca60": rates.per60(ca, toi), "cf_percent": rates.percent(cf, ca), "goals_per_hit": rates.divide(F.col("goals"), F.col("hits"), 0.0)}
    return views.player_games(spark, sf_dir).select("season", "game_id", "player_id", "team_id", *(F.round(c, 6).alias(k) for k, c in found.items()))


@query("SELECT o_orderkey, CAST(year(o_orderdate) * 10000 + year(o_orderdate) + 1 AS BIGINT) AS season FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
def partition_prune(spark, sf_dir):
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").where((day >= "1998-01-01") & (day < "1999-01-01")).select("o_orderkey", season_of_year(F.year(day)).alias("season"))
