"""Domain queries: boxscores, features, transitions, lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftframe.operators import boxscore as B
from shiftframe.operators import features, lines, transitions
from shiftframe.sources.tables import table

from . import views
from .catalog import query
from .views import with_views

#: Stand-in codes of the boxscore's events.
CODES = {"click": "SHOT", "purchase": "GOAL", "view": "HIT", "signup": "FAC", "error": "PENL"}
ROLE_SQL = """, ev AS (SELECT event_id, 20232024 AS season, event_id // 20 AS game_id, CASE event_type """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CODES.items()) + """ END AS event_type, user_id FROM events),
rl AS (SELECT season, game_id, event_type, 'p1' AS role, user_id AS player_id FROM ev UNION ALL SELECT season, game_id, event_type, 'p2', user_id + 1 FROM ev WHERE event_id % 3 > 0 UNION ALL SELECT season, game_id, event_type, 'p3', user_id + 2 FROM ev WHERE event_id % 2 = 0)"""


def _count_sql(column: str) -> str:
    pairs = [k for k, v in B.CREDITS.items() if column in v]
    return f"count(*) FILTER (WHERE {' OR '.join(f'''(event_type = '{e}' AND role = '{r}')''' for e, r in pairs)}) AS {column}"


@query(
    with_views(
        ROLE_SQL + ", box AS (SELECT season, game_id, player_id, " + ", ".join(map(_count_sql, B.COLUMNS)) + " FROM rl GROUP BY ALL), "
        "team AS (SELECT game_id, player_id, team_id FROM (SELECT *, row_number() OVER (PARTITION BY game_id, player_id ORDER BY n DESC, team_id) AS k FROM (SELECT event_id // 20 AS game_id, user_id AS player_id, event_id % 2 AS team_id, count(*) AS n FROM events GROUP BY ALL)) WHERE k = 1) "
        "SELECT game_id, player_id, CAST(season AS BIGINT) AS season, " + ", ".join(B.COLUMNS) + ", goals + assists AS points, team_id FROM box JOIN team USING (game_id, player_id)",
        "v_team_code",
    )
)
def boxscore(spark, sf_dir):
    code = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    events = table(spark, sf_dir, "events")
    name = lambda k: (F.col("user_id") + k).cast("string")
    wide = events.select(
        F.lit(20232024).cast("long").alias("season"), F.expr("event_id div 20").alias("game_id"), "event_id", F.try_element_at(code, F.col("event_type")).alias("event_type"),
        name(0).alias("p1"), F.when(F.col("event_id") % 3 > 0, name(1)).alias("p2"), F.when(F.col("event_id") % 2 == 0, name(2)).alias("p3"),
    )
    rows = B.role_rows(wide, ["season", "game_id", "event_id", "event_type"], ["p1", "p2", "p3"]).withColumn("player_id", F.col("player_raw").cast("long"))
    teams = events.select(F.expr("event_id div 20").alias("game_id"), F.col("user_id").alias("player_id"), (F.col("event_id") % 2).alias("team_id"))
    return B.boxscore(rows, teams)


@query(
    with_views(
        """, t AS (SELECT season, game_id, team_id, CAST(sum(cf) AS BIGINT) AS cf, CAST(sum(ca) AS BIGINT) AS ca, CAST(sum(goals) AS BIGINT) AS goals FROM v_pg GROUP BY ALL)
    SELECT a.season, a.game_id, a.team_id, a.cf, round(a.cf / nullif(a.cf + a.ca, 0), 6) AS cf_percent, a.goals AS goals_for, b.goals AS goals_against, CAST(CASE WHEN a.goals > b.goals THEN 1 ELSE 0 END AS INT) AS win
    FROM t a JOIN t b ON a.season = b.season AND a.game_id = b.game_id AND a.team_id <> b.team_id""",
        "v_pg",
    )
)
def team_game(spark, sf_dir):
    games = features.team_games(views.player_games(spark, sf_dir))
    rows = features.with_opponent(games, ["goals"])
    win = F.when(F.col("goals") > F.col("opp_goals"), 1).otherwise(0)
    return rows.select("season", "game_id", "team_id", "cf", F.round("cf_percent", 6).alias("cf_percent"), F.col("goals").alias("goals_for"), F.col("opp_goals").alias("goals_against"), win.alias("win"))


@query(
    with_views(
        """, s AS (SELECT season, player_id, team_id, CAST(sum(cf) AS BIGINT) AS cf, CAST(sum(ca) AS BIGINT) AS ca, CAST(sum(toi_es_sec) AS BIGINT) AS es, CAST(sum(toi_total_sec) AS BIGINT) AS tot, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(hits) AS BIGINT) AS hits, count(*) AS games FROM v_pg GROUP BY ALL)
    SELECT season, player_id, team_id, games, round(goals * 3600.0::DOUBLE / tot, 6) AS g60, round(hits * 3600.0::DOUBLE / tot, 6) AS hit60, round(cf * 3600.0::DOUBLE / es, 6) AS cf60, round(ca * 3600.0::DOUBLE / es, 6) AS ca60,
    round(es / tot, 6) AS es_share, round(tot / 60.0::DOUBLE / games, 6) AS toi_per_game FROM s WHERE tot >= 200 * 60""",
        "v_pg",
    )
)
def season_features(spark, sf_dir):
    rates = ("g60", "hit60", "cf60", "ca60", "es_share", "toi_per_game")
    rows = features.season_features(views.player_games(spark, sf_dir), least_minutes=200)
    return rows.select("season", "player_id", "team_id", "games", *(F.round(c, 6).alias(c) for c in rates))


@query(
    with_views(
        """, e AS (SELECT pos_group, quantile_cont(ca60, [0.01, 0.99]) AS q FROM v_ps GROUP BY pos_group)
    SELECT season, player_id, round(greatest(q[1], least(q[2], ca60)), 6) AS ca60 FROM v_ps JOIN e USING (pos_group)""",
        "v_ps",
    )
)
def winsorised_rates(spark, sf_dir):
    held = features.winsorised(views.player_seasons(spark, sf_dir), ["ca60"], ["pos_group"])
    return held.select("season", "player_id", F.round("ca60", 6).alias("ca60"))


DIRICHLET = """, pairs AS (SELECT a.pos_group, a.cluster AS f, b.cluster AS t FROM v_ps a JOIN v_ps b ON a.player_id = b.player_id AND b.season = a.season + 10001),
grid AS (SELECT pos_group, f, t FROM (SELECT DISTINCT pos_group FROM pairs), (SELECT unnest([0, 1, 2])::BIGINT AS f), (SELECT unnest([0, 1, 2])::BIGINT AS t)),
mx AS (SELECT pos_group, f AS from_cluster, t AS to_cluster, n, (n + 1.0::DOUBLE) / sum(n + 1.0::DOUBLE) OVER (PARTITION BY pos_group, f) AS prob_mean
FROM (SELECT g.pos_group, g.f, g.t, count(p.pos_group) AS n FROM grid g LEFT JOIN pairs p ON p.pos_group = g.pos_group AND p.f = g.f AND p.t = g.t GROUP BY ALL))"""


@query(with_views(DIRICHLET + " SELECT pos_group, from_cluster, to_cluster, n, round(prob_mean, 8) AS prob_mean FROM mx", "v_ps"))
def dirichlet(spark, sf_dir):
    pairs = transitions.transition_pairs(views.player_seasons(spark, sf_dir))
    return transitions.dirichlet(pairs).withColumn("prob_mean", F.round("prob_mean", 8))


@query("SELECT event_id, round(a / nullif(a + b + c, 0), 8) AS p0, round(b / nullif(a + b + c, 0), 8) AS p1, round(c / nullif(a + b + c, 0), 8) AS p2 FROM (SELECT event_id, value AS a, CAST(event_id % 7 AS DOUBLE) AS b, coalesce(CASE WHEN event_id % 5 > 0 THEN CAST(event_id % 3 AS DOUBLE) END, 0) AS c FROM events)")
def prob_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("p0"), (F.col("event_id") % 7).cast("double").alias("p1"), F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 3).cast("double")).alias("p2"))
    return transitions.renormalised(rows, ["p0", "p1", "p2"]).select("event_id", *(F.round(c, 8).alias(c) for c in ("p0", "p1", "p2")))


LINES = """, r AS (SELECT *, row_number() OVER (PARTITION BY season, team_id ORDER BY toi_es_sec DESC, player_id) AS k FROM v_ps WHERE pos_group = 'F'),
ln AS (SELECT season, team_id, CAST((k - 1) // 3 + 1 AS INT) AS line, CAST(sum(cf) AS BIGINT) AS cf, CAST(sum(ca) AS BIGINT) AS ca, CAST(sum(toi_es_sec) AS BIGINT) AS toi,
count(*) FILTER (WHERE cluster = 0) AS c0, count(*) FILTER (WHERE cluster = 1) AS c1, count(*) FILTER (WHERE cluster = 2) AS c2 FROM r WHERE k <= 12 GROUP BY ALL HAVING count(*) = 3)"""


def _lines(spark, sf_dir):
    return lines.line_totals(views.player_seasons(spark, sf_dir).where("pos_group = 'F'"))


@query(with_views(LINES + " SELECT * FROM ln", "v_ps"))
def line_totals(spark, sf_dir):
    return _lines(spark, sf_dir)


MATCHUP = """, t AS (SELECT season, game_id, team_id, sum(cf) AS cf, sum(ca) AS ca, sum(toi_es_sec) AS toi FROM v_pg GROUP BY ALL),
o AS (SELECT a.season, a.game_id, a.team_id, sum(b.cf) AS cf, sum(b.ca) AS ca, sum(b.toi) AS toi FROM t a JOIN t b ON a.season = b.season AND a.game_id = b.game_id AND a.team_id <> b.team_id GROUP BY ALL)
SELECT season, game_id, team_id, CAST(t.cf AS BIGINT) AS team_cf, CAST(o.cf AS BIGINT) AS opp_cf, CAST(t.toi AS BIGINT) AS team_toi, CAST(o.toi AS BIGINT) AS opp_toi,
round(t.cf / (t.cf + t.ca), 6) AS team_cf_share, round(o.cf / (o.cf + o.ca), 6) AS opp_cf_share FROM t JOIN o USING (season, game_id, team_id)"""


@query(with_views(MATCHUP, "v_pg"))
def line_matchup(spark, sf_dir):
    rows = views.player_games(spark, sf_dir).select("season", "game_id", "team_id", "cf", "ca", F.col("toi_es_sec").alias("toi"))
    found = lines.line_matchup(rows)
    return found.select("season", "game_id", "team_id", "team_cf", "opp_cf", "team_toi", "opp_toi", *(F.round(c, 6).alias(c) for c in ("team_cf_share", "opp_cf_share")))
