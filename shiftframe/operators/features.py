"""Team-game and player-season features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftframe.functions.rates import divide, per60

from .ordering import quantile_edges, sums_before

SEASON_GAME = ["season", "game_id"]


def with_opponent(games: DataFrame, values: list[str]) -> DataFrame:
    """Each team's row of a game beside each other team's: opp_ and diff_ of the values; lone teams have none."""
    other = games.select(*SEASON_GAME, F.col("team_id").alias("opp_team_id"), *(F.col(v).alias(f"opp_{v}") for v in values))
    both = games.join(other, SEASON_GAME).where("team_id <> opp_team_id")
    return both.withColumns({f"diff_{v}": F.col(v) - F.col(f"opp_{v}") for v in values})


#: What is summed over a team's players, where a table has it.
SUMS = ("toi_es_sec", "toi_total_sec", "cf", "ca", "goals", "assists", "points", "shots", "hits", "blocked", "takeaways", "giveaways", "faceoff_wins", "faceoff_taken", "penalties_taken")
RATES = ("cf_percent", "cf60", "ca60", "fo_percent")
#: The columns whose trailing means describe a team before a game.
BASE = ("cf_percent", "cf60", "ca60", "diff_cf_percent", "diff_cf60", "diff_ca60", "shots", "hits", "blocked", "takeaways", "giveaways", "penalties_taken", "fo_percent", "diff_fo_percent", "toi_es_sec")
SHARES = tuple(f"{p}_share_{k}" for p in "FD" for k in range(3))
ROLLED = tuple(f"roll15_{c}" for c in BASE + SHARES)


def team_games(player_games: DataFrame) -> DataFrame:
    """(season, game_id, team_id) sums, with cf_percent from 0 to 1."""
    sums = player_games.groupBy(*SEASON_GAME, "team_id").agg(*(F.sum(c).alias(c) for c in SUMS if c in player_games.columns))
    return sums.withColumn("cf_percent", divide(F.col("cf"), F.col("cf") + F.col("ca")))


def team_game_rates(player_games: DataFrame) -> DataFrame:
    """``team_games`` with attempts per hour of equal strength, the share of faceoffs won, and the opponent's goals and rates beside; lone teams have no row."""
    return with_opponent(_rated(team_games(player_games)), ["goals", *RATES])


def _rated(games: DataFrame) -> DataFrame:
    es = F.col("toi_es_sec")
    return games.withColumns({"cf60": per60(F.col("cf"), es), "ca60": per60(F.col("ca"), es), "fo_percent": divide(F.col("faceoff_wins"), F.col("faceoff_taken"))})


def role_shares(player_games: DataFrame, archetypes: DataFrame) -> DataFrame:
    """(season, game_id, team_id) and each role's share of the team's equal-strength time in the game; players without a role count in the whole alone."""
    roles = archetypes.select("season", "player_id", F.concat("pos_group", F.lit("_share_"), F.col("cluster").cast("string")).alias("role"))
    rows = player_games.select(*SEASON_GAME, "player_id", "team_id", "toi_es_sec").join(roles, ["season", "player_id"], "left")
    seconds = {c: F.sum(F.when(F.col("role") == c, F.col("toi_es_sec"))) for c in SHARES}
    return rows.groupBy(*SEASON_GAME, "team_id").agg(*(F.coalesce(divide(s, F.sum("toi_es_sec")), F.lit(0.0)).alias(c) for c, s in seconds.items()))


def beside_opponents(games: DataFrame, values: list[str]) -> DataFrame:
    """``with_opponent`` with the teams of a game dealt once, together, instead of joined to themselves."""
    teams = games.where("season IS NOT NULL AND game_id IS NOT NULL").groupBy(*SEASON_GAME).agg(F.collect_list(F.struct(*(c for c in games.columns if c not in SEASON_GAME))).alias("__teams"))
    pairs = teams.select("*", F.explode("__teams").alias("__own")).select(*SEASON_GAME, "__own", F.explode("__teams").alias("__opp")).where("__own.team_id <> __opp.team_id")
    both = pairs.select(*SEASON_GAME, "__own.*", F.col("__opp.team_id").alias("opp_team_id"), *(F.col(f"__opp.{v}").alias(f"opp_{v}") for v in values))
    return both.withColumns({f"diff_{v}": F.col(v) - F.col(f"opp_{v}") for v in values})


def model_table_once(player_games: DataFrame, archetypes: DataFrame, size: int = 15, least: int = 5) -> DataFrame:
    """``model_table`` with sums and shares met by team before the teams of a game are dealt to each other: a team's sums are made and dealt once."""
    games = _rated(team_games(player_games)).join(role_shares(player_games, archetypes), [*SEASON_GAME, "team_id"])
    games = games.select(*SEASON_GAME, "team_id", *dict.fromkeys(c for c in ("goals", *RATES, *BASE, *SHARES) if c in games.columns))  # what is dealt in lists is not pruned
    return _model_rows(beside_opponents(games, ["goals", *RATES]), size, least)


def model_table(player_games: DataFrame, archetypes: DataFrame, size: int = 15, least: int = 5) -> DataFrame:
    """(season, game_id, team_id, opp_team_id, win, goal_diff) and the means of ``BASE`` and ``SHARES`` over the team's games of the season before this one.

    Only games with all means have a row. A player's game may be in several rows of ``player_games``: they are only added up.
    """
    return _model_rows(team_game_rates(player_games).join(role_shares(player_games, archetypes), [*SEASON_GAME, "team_id"]), size, least)


def _model_rows(games: DataFrame, size: int, least: int) -> DataFrame:
    back = Window.partitionBy("season", "team_id").orderBy("game_id").rowsBetween(-size, -1)
    means = {f"roll15_{c}": F.when(F.count(c).over(back) >= least, F.avg(c).over(back)) for c in BASE + SHARES}
    labels = {"win": (F.col("goals") > F.col("opp_goals")).cast("double"), "goal_diff": F.col("diff_goals").cast("double")}
    found = games.select(*SEASON_GAME, "team_id", "opp_team_id", *(c.alias(n) for n, c in (labels | means).items()))
    return found.where(~F.exists(F.array(*means, "win"), lambda x: x.isNull()))  # one condition: Spark would derive many from one a column


def rolling_mean(df: DataFrame, value: str, name: str, order: list[Column], keys: list[str] | None = None, size: int = 15, least: int = 5) -> DataFrame:
    """``name``: the mean of the ``size`` rows before this one of its key, null with fewer than ``least``."""
    w = Window.partitionBy(*(keys or [])).orderBy(*order)
    back = w.rowsBetween(-size, -1)
    return df.withColumn(name, F.when(F.count(value).over(back) >= least, F.avg(value).over(back)))


def rolling_mean_flat(df: DataFrame, value: str, name: str, order: list[Column], keys: list[str], size: int = 15, least: int = 5) -> DataFrame:
    """Like ``rolling_mean``, but with windows that reach over the keys' boundaries, as a flat series' would.

    One order over all rows cannot be split by key. Each row's place in it is its
    key's offset and its place within the key; a row then sees the ``size``
    before it by a window within its own block of places and copies of the last
    rows of the block before, so that no task holds more than a block.
    """
    shifted = df.withColumn("__v", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    block = 1 << 16
    rows = numbered(shifted, keys, order, "__at").withColumn("__b", F.floor(F.col("__at") / block)).withColumn("__own", F.lit(True))
    tail = rows.where(F.col("__at") % block >= block - size + 1).withColumns({"__b": F.col("__b") + 1, "__own": F.lit(False)})
    w = Window.partitionBy("__b").orderBy("__at").rowsBetween(-(size - 1), 0)
    out = rows.unionByName(tail).withColumn(name, F.when(F.count("__v").over(w) >= least, F.avg("__v").over(w)))
    return out.where("__own").drop("__v", "__at", "__b", "__own")


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``name``: each row's place, from 0, in the order of the keys and then of ``order``.

    The keys' row counts are summed along the first key's values, in blocks of them, and then within a value.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    first = sums_before(counts.groupBy(keys[0]).agg(F.sum("__n").alias("__n")), keys[0], ["__n"]).select(keys[0], F.col("before___n").alias("__first"))
    own = F.coalesce(F.sum("__n").over(Window.partitionBy(keys[0]).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.withColumn("__own", own).join(first, keys[0]).select(*keys, (F.col("__first") + F.col("__own")).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.join(before, keys).withColumn(name, F.col("__before") + within).drop("__before")


def season_features(games: DataFrame, least_minutes: float = 0.0) -> DataFrame:
    """A player's season: per-60 rates over total time for counts, over equal-strength time for attempts."""
    sums = games.groupBy("season", "player_id", "team_id").agg(*(F.sum(c).alias(c) for c in ("cf", "ca", "toi_es_sec", "toi_total_sec", "goals", "hits")), F.count("*").alias("games"))
    es, total = F.col("toi_es_sec"), F.col("toi_total_sec")
    rates = {"g60": per60(F.col("goals"), total), "hit60": per60(F.col("hits"), total), "cf60": per60(F.col("cf"), es), "ca60": per60(F.col("ca"), es)}
    rates |= {"es_share": divide(es, total), "toi_per_game": divide(total / 60.0, F.col("games"))}
    return sums.withColumns(rates).where(total >= least_minutes * 60)


def winsorised(df: DataFrame, columns: list[str], keys: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Columns held within their group's quantiles."""
    held = df
    for c in columns:
        held = held.join(quantile_edges(df, c, [low, high], keys).withColumnRenamed("edges", f"__{c}"), keys, "left")
    return held.withColumns({c: F.greatest(F.col(f"__{c}")[0], F.least(F.col(f"__{c}")[1], F.col(c))) for c in columns}).drop(*(f"__{c}" for c in columns))
