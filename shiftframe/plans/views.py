"""Shift, play and player views over the generic tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftframe.functions.seasons import season_of_year
from shiftframe.sources.tables import table


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(game_id, player_id, team_id, position, shift_start, shift_end), one row a shift."""
    part = F.col("l_suppkey") % 10
    start = (F.col("l_partkey") * 37 + F.col("l_linenumber") * 211) % 3600
    return table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 30").alias("game_id"),
        F.col("l_suppkey").alias("player_id"),
        (F.col("l_suppkey") % 2).alias("team_id"),
        F.when(part == 0, "G").when(part <= 3, "D").otherwise("F").alias("position"),
        start.alias("shift_start"),
        (start + F.col("l_quantity").cast("long")).alias("shift_end"),
    )


EVENT_NAMES = {"click": "Shot", "purchase": "Goal", "view": "Missed Shot", "signup": "Blocked Shot"}


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, game_id, time, event, team_id_for, team_id_against), one row an event."""
    kind = F.create_map(*(F.lit(x) for pair in EVENT_NAMES.items() for x in pair))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.expr("event_id div 20").alias("game_id"),
        ((F.col("event_id") * 613) % 3600).alias("time"),
        F.try_element_at(kind, F.col("event_type")).alias("event"),
        (F.col("user_id") % 2).alias("team_id_for"),
        (1 - F.col("user_id") % 2).alias("team_id_against"),
    )


#: Orders of one round of games, and teams; a year's games begin at the year times ``YEAR``.
ROUND, TEAMS, YEAR = 128, 25, 10_000_000_000


def first_game(day: str, order: str) -> Column:
    """The least game id of an order's round."""
    return F.year(day) * F.lit(YEAR) + F.expr(f"{order} div {ROUND}") * TEAMS


def player_rows(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(season, game_id, player_id, team_id) with attempts, seconds on ice and counts; a player's game may be in several rows, which add up.

    In round r team t meets the team that t and it add up to r, modulo 25, so that a game has two teams; the team
    that would meet itself has a game alone. Seasons ``first`` to ``last`` are a range of days, which the scan can
    check against the files' statistics.
    """
    q, n, part = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long"), F.col("l_partkey")
    team = (F.col("l_suppkey") + F.col("l_linenumber") % 2) % TEAMS
    other = F.pmod(F.expr(f"l_orderkey div {ROUND}") - team, F.lit(TEAMS))
    days = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    if first is not None:
        days = days.where(F.col("o_orderdate") >= F.lit(f"{first // 10000}-01-01").cast("timestamp"))
    if last is not None:
        days = days.where(F.col("o_orderdate") < F.lit(f"{last // 10000 + 1}-01-01").cast("timestamp"))
    rows = table(spark, sf_dir, "lineitem").join(days, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        season_of_year(F.year("o_orderdate")).alias("season"),
        (first_game("o_orderdate", "l_orderkey") + F.least(team, other)).alias("game_id"),
        F.col("l_suppkey").alias("player_id"),
        team.alias("team_id"),
        q.alias("cf"),
        (n * 5).alias("ca"),
        (q * 60).alias("toi_es_sec"),
        (q * 60 + n * 30).alias("toi_total_sec"),
        (F.col("l_returnflag") == "R").cast("long").alias("goals"),
        (F.col("l_linestatus") == "F").cast("long").alias("hits"),
        (part % 5 == 0).cast("long").alias("assists"),
        ((F.col("l_returnflag") == "R").cast("long") + (part % 5 == 0).cast("long")).alias("points"),
        (q % 7).alias("shots"),
        (part % 3).alias("blocked"),
        ((part + n) % 2).alias("takeaways"),
        (F.expr("l_partkey div 2") % 2).alias("giveaways"),
        F.least(part % 11, q % 6).alias("faceoff_wins"),
        (part % 11).alias("faceoff_taken"),
        (F.col("l_discount") > 0.08).cast("long").alias("penalties_taken"),
    )


def player_games(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """``player_rows`` added up: one row for each player's game for a team."""
    rows = player_rows(spark, sf_dir, first, last)
    keys = ("season", "game_id", "player_id", "team_id")
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in rows.columns if c not in keys))


PLAYER_SUMS = ("cf", "ca", "toi_es_sec", "toi_total_sec", "goals", "hits", "points", "shots", "blocked", "takeaways", "giveaways", "faceoff_wins", "faceoff_taken", "penalties_taken")
#: A season's counts an hour of all ice time.
PER_HOUR = {"p60": "points", "s60": "shots", "hit60": "hits", "blk60": "blocked", "take60": "takeaways", "give60": "giveaways", "penl60": "penalties_taken"}


def player_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(season, player_id) with its main team, position, archetype, sums and rates."""
    games = player_games(spark, sf_dir).where("season is not null and player_id is not null")
    by_team = games.groupBy("season", "player_id", "team_id").agg(*(F.sum(c).alias(c) for c in PLAYER_SUMS), F.count("*").alias("games"))
    main = F.max_by("team_id", F.struct("toi_total_sec", -F.col("team_id")))  # of equal times the least team's
    sums = by_team.groupBy("season", "player_id").agg(main.alias("team_id"), *(F.sum(c).alias(c) for c in (*PLAYER_SUMS, "games")))
    year, player = F.expr("season div 10000"), F.col("player_id")
    return sums.select(
        "season",
        "player_id",
        "team_id",
        F.when(player % 3 == 0, "D").otherwise("F").alias("pos_group"),
        ((player * 7 + year * 5 + (player * year) % 3) % 3).alias("cluster"),
        "cf",
        "ca",
        "toi_es_sec",
        "toi_total_sec",
        "goals",
        "hits",
        "games",
        (F.col("cf") * 3600 / F.col("toi_es_sec")).alias("cf60"),
        (F.col("ca") * 3600 / F.col("toi_es_sec")).alias("ca60"),
        (F.col("toi_es_sec") / F.col("toi_total_sec")).alias("es_share"),
        (F.col("toi_total_sec") / 60.0 / F.col("games")).alias("toi_per_game"),
        *((F.col(c) * 3600 / F.col("toi_total_sec")).alias(n) for n, c in PER_HOUR.items()),
        (F.col("cf") * 100 / (F.col("cf") + F.col("ca"))).alias("cf_percent"),
        ((F.col("cf") - F.col("ca")) * 3600 / F.col("toi_es_sec")).alias("es_net60"),
        F.coalesce(F.try_divide("faceoff_wins", "faceoff_taken"), F.lit(0.5)).alias("fo_win_pct"),
    )


def team_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("team_id"), F.col("n_name").alias("team_code"))


LINES = 1_000_000  # more than the lines of a text


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, first, last, name): a person for each line of each document, whose id is of both: its first word, and the next or the next two."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line"))
    words = F.split("line", " ")
    first, last = F.get(words, F.lit(0)), F.array_join(F.slice(words, 2, F.col("k") % 2 + 1), " ")
    rows = lines.select((F.col("doc_id") * LINES + F.col("k")).alias("doc_id"), first.alias("first"), last.alias("last"))
    return rows.withColumn("name", F.concat_ws(" ", "first", "last"))


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, name): the first two words of each page's title, which are to be known as people; the first is short of letters, or has one too many, on two pages of three."""
    pattern = r"(?s)<title[^>]*>([^ <]*) ?([^ <]*)"
    first, last, k = F.regexp_extract("html", pattern, 1), F.regexp_extract("html", pattern, 2), F.col("page_id") % 3
    spelt = F.when(k == 0, first).when(k == 1, F.left(first, F.greatest(F.length(first) - 2, F.lit(1)))).otherwise(F.concat(F.lit("x"), first))
    return table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", spelt, last).alias("name"))


SQL = {
    "v_shifts": """SELECT l_orderkey // 30 AS game_id, l_suppkey AS player_id, l_suppkey % 2 AS team_id,
        CASE WHEN l_suppkey % 10 = 0 THEN 'G' WHEN l_suppkey % 10 <= 3 THEN 'D' ELSE 'F' END AS position,
        (l_partkey * 37 + l_linenumber * 211) % 3600 AS shift_start,
        (l_partkey * 37 + l_linenumber * 211) % 3600 + CAST(l_quantity AS BIGINT) AS shift_end FROM lineitem""",
    "v_plays": """SELECT event_id, event_id // 20 AS game_id, (event_id * 613) % 3600 AS time,
        CASE event_type WHEN 'click' THEN 'Shot' WHEN 'purchase' THEN 'Goal' WHEN 'view' THEN 'Missed Shot' WHEN 'signup' THEN 'Blocked Shot' END AS event,
        user_id % 2 AS team_id_for, 1 - user_id % 2 AS team_id_against FROM events""",
    "v_pg": f"""SELECT CAST(year(o_orderdate) * 10000 + year(o_orderdate) + 1 AS BIGINT) AS season,
        year(o_orderdate) * {YEAR} + l_orderkey // {ROUND} * {TEAMS} + least((l_suppkey + l_linenumber % 2) % {TEAMS}, ((l_orderkey // {ROUND} - (l_suppkey + l_linenumber % 2) % {TEAMS}) % {TEAMS} + {TEAMS}) % {TEAMS}) AS game_id,
        l_suppkey AS player_id, (l_suppkey + l_linenumber % 2) % {TEAMS} AS team_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cf, CAST(sum(l_linenumber * 5) AS BIGINT) AS ca,
        CAST(sum(CAST(l_quantity AS BIGINT) * 60) AS BIGINT) AS toi_es_sec, CAST(sum(CAST(l_quantity AS BIGINT) * 60 + l_linenumber * 30) AS BIGINT) AS toi_total_sec,
        CAST(sum(CAST(l_returnflag = 'R' AS INT)) AS BIGINT) AS goals, CAST(sum(CAST(l_linestatus = 'F' AS INT)) AS BIGINT) AS hits,
        CAST(sum(CAST(l_partkey % 5 = 0 AS INT)) AS BIGINT) AS assists, CAST(sum(CAST(l_returnflag = 'R' AS INT) + CAST(l_partkey % 5 = 0 AS INT)) AS BIGINT) AS points,
        CAST(sum(CAST(l_quantity AS BIGINT) % 7) AS BIGINT) AS shots, CAST(sum(l_partkey % 3) AS BIGINT) AS blocked, CAST(sum((l_partkey + l_linenumber) % 2) AS BIGINT) AS takeaways,
        CAST(sum(l_partkey // 2 % 2) AS BIGINT) AS giveaways, CAST(sum(least(l_partkey % 11, CAST(l_quantity AS BIGINT) % 6)) AS BIGINT) AS faceoff_wins, CAST(sum(l_partkey % 11) AS BIGINT) AS faceoff_taken,
        CAST(sum(CAST(l_discount > 0.08 AS INT)) AS BIGINT) AS penalties_taken
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    "v_ps": f"""SELECT s.season, s.player_id, t.team_id, CASE WHEN s.player_id % 3 = 0 THEN 'D' ELSE 'F' END AS pos_group,
        (s.player_id * 7 + (s.season // 10000) * 5 + (s.player_id * (s.season // 10000)) % 3) % 3 AS cluster,
        s.cf, s.ca, s.toi_es_sec, s.toi_total_sec, s.goals, s.hits, s.games,
        s.cf * 3600 / s.toi_es_sec AS cf60, s.ca * 3600 / s.toi_es_sec AS ca60, s.toi_es_sec / s.toi_total_sec AS es_share, s.toi_total_sec / 60.0::DOUBLE / s.games AS toi_per_game,
        {", ".join(f"s.{c} * 3600 / s.toi_total_sec AS {n}" for n, c in PER_HOUR.items())}, s.cf * 100 / (s.cf + s.ca) AS cf_percent, (s.cf - s.ca) * 3600 / s.toi_es_sec AS es_net60,
        coalesce(s.faceoff_wins / nullif(s.faceoff_taken, 0), 0.5) AS fo_win_pct
        FROM (SELECT season, player_id, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in PLAYER_SUMS)}, count(*) AS games
              FROM v_pg GROUP BY season, player_id) s
        JOIN (SELECT season, player_id, team_id, row_number() OVER (PARTITION BY season, player_id ORDER BY sum(toi_total_sec) DESC, team_id) AS k
              FROM v_pg GROUP BY season, player_id, team_id) t ON s.season = t.season AND s.player_id = t.player_id AND t.k = 1""",
    "v_team_code": "SELECT CAST(n_nationkey AS BIGINT) AS team_id, n_name AS team_code FROM nation",
    "v_names": f"""SELECT doc_id, w[1] AS first, array_to_string(w[2:2 + k % 2], ' ') AS last, concat_ws(' ', w[1], array_to_string(w[2:2 + k % 2], ' ')) AS name
        FROM (SELECT doc_id * {LINES} + k AS doc_id, k, string_split(line, ' ') AS w FROM (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents))""",
    "v_titled": """SELECT page_id, concat_ws(' ', CASE page_id % 3 WHEN 0 THEN f WHEN 1 THEN left(f, greatest(length(f) - 2, 1)) ELSE 'x' || f END, l) AS name
        FROM (SELECT page_id, regexp_extract(html, '(?s)<title[^>]*>([^ <]*) ?([^ <]*)', 1) AS f, regexp_extract(html, '(?s)<title[^>]*>([^ <]*) ?([^ <]*)', 2) AS l FROM pages)""",
}
NEEDS = {"v_ps": ("v_pg",)}


def with_views(body: str, *views: str) -> str:
    """``body`` after a WITH clause of the views; a body that starts with a comma adds its own."""
    every = list(dict.fromkeys(x for v in views for x in (*NEEDS.get(v, ()), v)))
    return "WITH " + ",\n".join(f"{v} AS ({SQL[v]})" for v in every) + "\n" + body
