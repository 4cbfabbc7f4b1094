"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftframe.functions.names import normalize_name
from shiftframe.operators import checks, identity, intervals, possession, transitions
from shiftframe.sources.tables import table

from . import views
from .catalog import query
from .views import with_views


@query(with_views("SELECT game_id, player_id, team_id, team_code, shift_start FROM v_shifts JOIN v_team_code USING (team_id)", "v_shifts", "v_team_code"))
def dim_join(spark, sf_dir):
    codes = views.team_codes(spark, sf_dir)  # one row a nation: small enough for Spark to broadcast by its size
    return views.shifts(spark, sf_dir).join(codes, "team_id").select("game_id", "player_id", "team_id", "team_code", "shift_start")


@query(
    with_views(
        """, total AS (SELECT game_id, player_id, team_id, CAST(sum(shift_end - shift_start) AS BIGINT) AS toi_total_sec FROM v_shifts GROUP BY ALL),
    es AS (SELECT game_id, player_id, team_id, CAST(count(*) AS BIGINT) AS shifts FROM v_shifts WHERE position = 'D' GROUP BY ALL)
    SELECT game_id, player_id, team_id, shifts, coalesce(toi_total_sec, 0) AS toi_total_sec FROM es LEFT JOIN total USING (game_id, player_id, team_id)""",
        "v_shifts",
    )
)
def es_total_toi(spark, sf_dir):
    shifts = views.shifts(spark, sf_dir)
    es = shifts.where("position = 'D'").groupBy(*possession.KEYS).agg(F.count("*").alias("shifts"))
    return es.join(intervals.total_toi(shifts, possession.KEYS, "toi_total_sec"), possession.KEYS, "left").na.fill(0, ["toi_total_sec"])


@query(
    with_views(
        """SELECT event_id, h.team_code AS home_code, a.team_code AS away_code, e.team_code AS event_code,
    CASE WHEN e.team_id = h.team_id THEN a.team_id ELSE h.team_id END AS team_id_against
    FROM events x LEFT JOIN v_team_code h ON h.team_id = x.event_id % 25 LEFT JOIN v_team_code a ON a.team_id = (x.event_id + 1) % 25 LEFT JOIN v_team_code e ON e.team_id = (x.event_id + x.user_id % 3) % 25""",
        "v_team_code",
    )
)
def role_dim_join(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 25).alias("home_id"), ((F.col("event_id") + 1) % 25).alias("away_id"), ((F.col("event_id") + F.col("user_id") % 3) % 25).alias("own_id"))
    for role in ("home", "away", "own"):
        rows = rows.join(views.team_codes(spark, sf_dir).toDF(f"{role}_id", f"{role}_code"), f"{role}_id", "left")
    against = F.when(F.col("own_id") == F.col("home_id"), F.col("away_id")).otherwise(F.col("home_id"))
    return rows.select("event_id", "home_code", "away_code", F.col("own_code").alias("event_code"), against.alias("team_id_against"))


@query(with_views("SELECT a.player_id, a.season AS season_t, b.season AS season_t1, a.pos_group, a.cluster AS cluster_t, b.cluster AS cluster_t1 FROM v_ps a JOIN v_ps b ON a.player_id = b.player_id AND b.season = a.season + 10001", "v_ps"))
def transition_pairs(spark, sf_dir):
    pairs = transitions.transition_pairs(views.player_seasons(spark, sf_dir))
    return pairs.select("player_id", F.col("season").alias("season_t"), "season_t1", "pos_group", F.col("cluster").alias("cluster_t"), "cluster_t1")


@query(
    with_views(
        """, teams AS (SELECT season, player_id, team_id, (team_id + season // 10000) % 3 AS cluster, CAST(sum(toi_es_sec) AS BIGINT) AS toi FROM v_pg GROUP BY ALL),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, season ORDER BY toi DESC, team_id) AS k FROM teams) WHERE k = 1)
    SELECT a.player_id, a.season AS season_t, a.team_id, a.cluster AS cluster_t, b.cluster AS cluster_t1 FROM teams a JOIN one b ON a.player_id = b.player_id AND b.season = a.season + 10001""",
        "v_pg",
    )
)
def transition_pairs_dedup(spark, sf_dir):
    rows = views.player_games(spark, sf_dir).groupBy("season", "player_id", "team_id").agg(F.sum("toi_es_sec").alias("toi"))
    rows = rows.withColumn("cluster", (F.col("team_id") + F.expr("season div 10000")) % 3)
    pairs = transitions.transition_pairs_dedup(rows, [F.desc("toi"), F.asc("team_id")])
    return pairs.select("player_id", F.col("season").alias("season_t"), "team_id", F.col("cluster").alias("cluster_t"), "cluster_t1")


TEAM_GAMES = "tg AS (SELECT season, game_id, team_id, CAST(sum(cf) AS BIGINT) AS cf, CAST(sum(ca) AS BIGINT) AS ca FROM v_pg GROUP BY ALL)"


@query(with_views(", " + TEAM_GAMES + " SELECT a.season, a.game_id, a.team_id, b.team_id AS opp_team_id, a.cf, b.cf AS opp_cf, a.cf - b.cf AS diff_cf FROM tg a JOIN tg b ON a.season = b.season AND a.game_id = b.game_id AND a.team_id <> b.team_id", "v_pg"))
def opponent_diff(spark, sf_dir):
    from shiftframe.operators.features import with_opponent

    games = views.player_games(spark, sf_dir).groupBy("season", "game_id", "team_id").agg(F.sum("cf").alias("cf"))
    return with_opponent(games, ["cf"])


@query(with_views("SELECT s.game_id, s.player_id, s.shift_start, t.team_id FROM v_shifts s JOIN (SELECT DISTINCT game_id, player_id, team_id FROM v_shifts WHERE position <> 'G') t USING (game_id, player_id)", "v_shifts"))
def legacy_attach(spark, sf_dir):
    shifts = views.shifts(spark, sf_dir)
    teams = shifts.where("position <> 'G'").select("game_id", "player_id", "team_id").distinct()
    return shifts.select("game_id", "player_id", "shift_start").join(teams, ["game_id", "player_id"])


BOTH_SIDES = """, a AS (SELECT DISTINCT season, game_id, player_id, team_id FROM v_pg WHERE goals > 0), b AS (SELECT DISTINCT season, game_id, player_id, team_id FROM v_pg WHERE hits > 0)
    SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM a JOIN b USING (season, game_id, player_id, team_id)) AS n_matched"""


@query(with_views(BOTH_SIDES, "v_pg"))
def match_rate(spark, sf_dir):
    games, keys = views.player_games(spark, sf_dir), ["season", "game_id", "player_id", "team_id"]
    return checks.match_rate(games.where("goals > 0").select(*keys).distinct(), games.where("hits > 0").select(*keys).distinct(), keys)


@query("SELECT CAST(n_nationkey AS BIGINT) AS code, 'left' AS side FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) UNION ALL SELECT DISTINCT CAST(s_nationkey AS BIGINT), 'right' FROM supplier WHERE s_acctbal < 0 AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 1)")
def unmatched_codes(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("code"), "n_regionkey")
    used = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").cast("long").alias("code")).distinct()
    left = nations.select("code").join(used, "code", "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(used.join(nations.where("n_regionkey > 1"), "code", "left_anti").withColumn("side", F.lit("right")))


@query("SELECT c_custkey, n_name FROM (SELECT *, ' nation_' || c_nationkey || '  ' AS raw FROM customer) JOIN nation ON upper(trim(raw)) = upper(trim(n_name))")
def norm_key_join(spark, sf_dir):
    raw = F.concat(F.lit(" nation_"), F.col("c_nationkey").cast("string"), F.lit("  "))
    people = table(spark, sf_dir, "customer").select("c_custkey", F.upper(F.trim(raw)).alias("key"))
    nations = table(spark, sf_dir, "nation").select("n_name", F.upper(F.trim("n_name")).alias("key"))
    return people.join(nations, "key").select("c_custkey", "n_name")


NORM = (
    "trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(strip_accents(lower(trim(name))), '.', ' '), '-', ' '), "
    "'\\b([od])[''’]', '\\1', 'g'), '[^a-z ]', ' ', 'g'), '\\s+', ' ', 'g'))"
)
NORMAL = f"coalesce(regexp_replace(regexp_replace({NORM}, '\\b([a-z])\\s+([a-z])\\b', '\\1\\2', 'g'), '\\b([a-z])\\s+([a-z])\\b', '\\1\\2', 'g'), '')"


@query(
    with_views(
        f""", p AS (SELECT doc_id, {NORMAL} AS full_name FROM v_names), ext AS (SELECT doc_id AS ext_id, doc_id AS player_id FROM v_names WHERE starts_with(name, 'D')),
    uni AS (SELECT full_name, min(doc_id) AS player_id FROM p WHERE full_name <> '' GROUP BY full_name HAVING count(DISTINCT doc_id) = 1),
    last AS (SELECT full_name, max(doc_id) AS player_id FROM p WHERE full_name <> '' GROUP BY full_name)
    SELECT p.doc_id AS ext_id, p.full_name, coalesce(e.player_id, u.player_id, l.player_id) AS player_id, CAST(CASE WHEN e.player_id IS NOT NULL THEN 1 WHEN u.player_id IS NOT NULL THEN 2 WHEN l.player_id IS NOT NULL THEN 3 END AS INT) AS step
    FROM p LEFT JOIN ext e ON e.ext_id = p.doc_id LEFT JOIN uni u ON u.full_name = p.full_name LEFT JOIN last l ON l.full_name = p.full_name""",
        "v_names",
    )
)
def id_cascade(spark, sf_dir):
    people = views.names(spark, sf_dir).select(F.col("doc_id").alias("ext_id"), normalize_name(F.col("name")).alias("full_name")).withColumn("player_id", F.col("ext_id"))
    known = views.names(spark, sf_dir).where("name LIKE 'D%'").select(F.col("doc_id").alias("ext_id"), F.col("doc_id").alias("player_id"))
    latest = people.where("full_name <> ''").groupBy("full_name").agg(F.max("player_id").alias("player_id"))
    steps = [(known, "ext_id"), (identity.unique_names(people, "player_id", "full_name"), "full_name"), (latest, "full_name")]
    return identity.id_cascade(people.select("ext_id", "full_name"), steps, "player_id").select("ext_id", "full_name", "player_id", "step")


@query(with_views("SELECT CAST(count(*) AS BIGINT) AS n_missing FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey AND o.o_orderstatus <> 'P' WHERE o.o_orderkey IS NULL", "v_team_code"))
def ri_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey").join(orders, "l_orderkey", "left_anti").agg(F.count("*").alias("n_missing"))
