"""Roster composition, expected roles and net rates, and what-if swaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouping import shares, weighted_mean

ROLES = (0, 1, 2)
UNIFORM = 1.0 / 3


def weighted(roster: DataFrame, weighting: str = "toi") -> DataFrame:
    """``roster`` with weight: equal-strength seconds, or 1 for each player."""
    return roster.withColumn("weight", F.coalesce(F.col("toi_es_sec").cast("double"), F.lit(0.0)) if weighting == "toi" else F.lit(1.0))


def composition(roster: DataFrame, weighting: str = "toi", keys: list[str] | None = None) -> DataFrame:
    """(keys, pos_group, cluster, weight, share): each role's percentage of its position group."""
    keys = keys or []
    sums = weighted(roster, weighting).groupBy(*keys, "pos_group", "cluster").agg(F.sum("weight").alias("weight"))
    return shares(sums, "weight", [*keys, "pos_group"], "share")


def expected_composition(roster: DataFrame, matrix: DataFrame, weighting: str = "toi", keys: list[str] | None = None) -> DataFrame:
    """Next season's shares: players' weights dealt over roles by the transition matrix."""
    keys = keys or []
    moves = matrix.select("pos_group", F.col("from_cluster").alias("cluster"), F.col("to_cluster"), "prob_mean")
    dealt = weighted(roster, weighting).join(moves, ["pos_group", "cluster"])
    sums = dealt.groupBy(*keys, "pos_group", F.col("to_cluster").alias("cluster")).agg(F.sum(F.col("weight") * F.col("prob_mean")).alias("weight"))
    return shares(sums, "weight", [*keys, "pos_group"], "share")


def next_role_probs(roster: DataFrame, model: DataFrame, matrix: DataFrame) -> DataFrame:
    """``roster`` with p0, p1, p2: the model's by player, scaled to a sum of 1, else the matrix row as it is, else uniform.

    ``model`` has (player_id, m0, m1, m2). Its row counts as a whole: where a
    value is missing or not finite, or the sum is not positive, the matrix row stands in.
    """
    rows = matrix.groupBy("pos_group", F.col("from_cluster").alias("cluster")).agg(*(F.max(F.when(F.col("to_cluster") == k, F.col("prob_mean"))).alias(f"t{k}") for k in ROLES))
    own = [F.col(f"m{k}").cast("double") for k in ROLES]
    total = own[0] + own[1] + own[2]
    usable = F.coalesce((total > 0) & (F.abs(total) < float("inf")) & ~F.isnan(total), F.lit(False))  # null if any is
    known = F.coalesce(*(F.col(f"t{k}") for k in ROLES)).isNotNull()
    backoff = [F.when(known, F.coalesce(f"t{k}", F.lit(0.0))).otherwise(UNIFORM) for k in ROLES]
    both = roster.join(model.select("player_id", *(f"m{k}" for k in ROLES)), "player_id", "left").join(rows, ["pos_group", "cluster"], "left")
    return both.withColumns({f"p{k}": F.when(usable, own[k] / total).otherwise(backoff[k]) for k in ROLES}).drop(*(f"m{k}" for k in ROLES), *(f"t{k}" for k in ROLES))


def expected_composition_model(roster: DataFrame, model: DataFrame, matrix: DataFrame, weighting: str = "toi", keys: list[str] | None = None) -> DataFrame:
    """Like ``expected_composition`` by each player's own probabilities; unknown positions and roles are left out."""
    keys = keys or []
    known = roster.where(F.col("pos_group").isin("F", "D") & F.col("cluster").isin(*ROLES))
    rows = next_role_probs(weighted(known, weighting), model, matrix)
    deal = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("cluster"), (F.col("weight") * F.col(f"p{k}")).alias("weight")) for k in ROLES)))
    sums = rows.select(*keys, "pos_group", deal.alias("x")).groupBy(*keys, "pos_group", "x.cluster").agg(F.sum("x.weight").alias("weight"))
    return shares(sums, "weight", [*keys, "pos_group"], "share")


def center_net60(player_seasons: DataFrame) -> DataFrame:
    """(pos_group, cluster, net60): the mean of cf60 - ca60."""
    return player_seasons.groupBy("pos_group", "cluster").agg(F.avg(F.col("cf60") - F.col("ca60")).alias("net60"))


def expected_net60(roster: DataFrame, model: DataFrame, matrix: DataFrame, centers: DataFrame, weighting: str = "toi", keys: list[str] | None = None) -> DataFrame:
    """(keys, pos_group, net60): roles' net rates by next-role probabilities, weighted over players.

    Players without a position or a role are left out; without any weight the players' plain mean counts.
    """
    keys = keys or []
    known = roster.where(F.col("pos_group").isin("F", "D") & F.col("cluster").isNotNull())
    wide = centers.groupBy("pos_group").agg(*(F.coalesce(F.max(F.when(F.col("cluster") == k, F.col("net60"))), F.lit(0.0)).alias(f"c{k}") for k in ROLES))
    rows = next_role_probs(weighted(known, weighting), model, matrix).join(wide, "pos_group", "left")
    expected = sum((F.col(f"p{k}") * F.coalesce(f"c{k}", F.lit(0.0)) for k in ROLES[1:]), F.col("p0") * F.coalesce("c0", F.lit(0.0)))
    mean = F.coalesce(weighted_mean(expected, F.col("weight"), None), F.avg(expected), F.lit(0.0))
    return rows.groupBy(*keys, "pos_group").agg(mean.alias("net60"))


def swapped(roster: DataFrame, pool: DataFrame, remove: int | None, add: int | None) -> DataFrame:
    """The roster without one player and with the pool's first row of another; an unknown one adds nothing."""
    out = roster.where(~F.col("player_id").eqNullSafe(F.lit(remove))) if remove is not None else roster
    if add is None:
        return out
    first = F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc("toi_es_sec"), "season", "team_id"))
    new = pool.where(F.col("player_id") == add).withColumn("__k", first).where("__k = 1").drop("__k")
    return out.unionByName(new.select(*(c for c in new.columns if c in roster.columns)), allowMissingColumns=True)


def mix_delta(before: DataFrame, after: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, pos_group, cluster, before, after, delta) of two compositions, a missing role being 0."""
    on = [*(keys or []), "pos_group", "cluster"]
    both = before.select(*on, F.col("share").alias("before")).join(after.select(*on, F.col("share").alias("after")), on, "outer").na.fill(0.0, ["before", "after"])
    return both.withColumn("delta", F.round(F.col("after") - F.col("before"), 2))


def with_shift(rows: DataFrame, columns: list[str], total: Column, target: int, delta: Column, names: list[str], donor: int = 2, eps: float = 1e-12) -> DataFrame:
    """``rows`` with ``names``: the three share ``columns``, held to 0..1 and scaled to ``total``, after ``delta`` moves to ``target``.

    ``delta`` is absolute and capped by what the target has and what the others
    have. A gain comes from the donor first and then from the third role; a loss
    goes wholly to the donor (if that is the target, to the first other one).
    Each step is a column of its own, so that no step's expression repeats those before it.
    """
    zero, one, c = F.lit(0.0), F.lit(1.0), F.col
    clipped = lambda x: F.greatest(zero, F.least(one, x))
    rest = next(k for k in range(3) if k not in (target, donor))
    out = rows.withColumns({"__total": total, "__delta": delta} | {f"__h{k}": clipped(c(n)) for k, n in enumerate(columns)})
    out = out.withColumn("__sum", c("__h0") + c("__h1") + c("__h2"))
    out = out.withColumns({f"__g{k}": F.when(c("__sum") > eps, c(f"__h{k}") * (c("__total") / c("__sum"))).otherwise(c("__total") / 3.0) for k in range(3)})
    out = out.withColumn("__moved", F.greatest(-c(f"__g{target}"), F.least(c("__delta"), c("__total") - c(f"__g{target}"))))
    out = out.withColumns({"__gain": F.greatest(zero, c("__moved")), "__loss": F.greatest(zero, -c("__moved"))})
    out = out.withColumn("__first", F.least(c(f"__g{donor}"), c("__gain")) if donor != target else zero)
    out = out.withColumn("__second", F.when(c("__gain") - c("__first") > eps, F.least(c(f"__g{rest}"), c("__gain") - c("__first"))).otherwise(zero))
    after = {target: c(f"__g{target}") + c("__first") + c("__second") - c("__loss"), rest: c(f"__g{rest}") - c("__second") + (c("__loss") if donor == target else zero)}
    if donor != target:
        after[donor] = c(f"__g{donor}") - c("__first") + c("__loss")
    out = out.withColumns({f"__w{k}": clipped(after.get(k, c(f"__g{k}"))) for k in range(3)}).withColumn("__after", c("__w0") + c("__w1") + c("__w2"))
    moved = lambda k: F.when(c("__after") > eps, c(f"__w{k}") * (c("__total") / c("__after"))).otherwise(c(f"__w{k}"))
    found = {n: F.when(c("__total") < eps, zero).when(F.abs("__moved") < eps, c(f"__g{k}")).otherwise(moved(k)) for k, n in enumerate(names)}
    temporary = ["__total", "__delta", "__sum", "__moved", "__gain", "__loss", "__first", "__second", "__after", *(f"__{x}{k}" for x in "hgw" for k in range(3))]
    return out.withColumns(found).drop(*temporary)


def win_probability(features: list[Column], weights: list[float], bias: float) -> Column:
    """The logistic of a linear score."""
    score = sum((x * w for x, w in zip(features, weights, strict=True)), F.lit(bias))
    return 1 / (1 + F.exp(-score))


def simulated(rows: DataFrame, columns: list[str], weights: dict[str, float], bias: float, delta: Column, target: int = 0, donor: int = 2) -> DataFrame:
    """``rows`` with p_base, p_new and delta_p: the win probability before and after ``delta`` of the three share columns moves to ``target``.

    ``weights`` are a logistic model's, by feature; the shares keep their sum.
    """
    total = F.col(columns[0]) + F.col(columns[1]) + F.col(columns[2])
    names = [f"__new_{k}" for k in range(3)]
    moved = dict(zip(columns, names, strict=True))
    out = with_shift(rows, columns, total, target, delta, names, donor)
    base = win_probability([F.col(c) for c in weights], list(weights.values()), bias)
    new = win_probability([F.col(moved.get(c, c)) for c in weights], list(weights.values()), bias)
    return out.withColumns({"p_base": base, "p_new": new}).withColumn("delta_p", F.col("p_new") - F.col("p_base")).drop(*names)


def sensitivity_grid(rows: DataFrame, columns: list[str], deltas: tuple[float, ...], weights: dict[str, float], bias: float, target: int = 0, donor: int = 2, games: int = 82) -> DataFrame:
    """(delta_share, mean_change, wins): the mean change of the win probability as a share moves to one role."""
    grid = rows.withColumn("delta_share", F.explode(F.array(*map(F.lit, deltas))))
    found = simulated(grid, columns, weights, bias, F.col("delta_share"), target, donor)
    return found.groupBy("delta_share").agg(F.avg("delta_p").alias("mean_change")).withColumn("wins", F.col("mean_change") * games)


def failures(rows: DataFrame, prob: str, label: str, share: str) -> DataFrame:
    """The wrongly predicted rows with why, one flag a reason: sure of it, near even, or a side that dominated and lost."""
    p, y = F.col(prob), F.col(label)
    wrong = rows.where((p >= 0.5).cast("int") != y)
    return wrong.withColumns({"confident": (p < 0.3) | (p > 0.7), "near_even": (p > 0.48) & (p < 0.52), "dominant_loss": (F.col(share) > 0.55) & (y == 0)})


def failure_examples(found: DataFrame, prob: str, game: str, order: list[str]) -> DataFrame:
    """One row for each reason that has one, with its category, each of another game: of the sure ones that of the least
    probability, of the others the first by ``order``."""
    pick = lambda rows, *by: rows.orderBy(*by).limit(1)
    high = pick(found.where("confident"), prob, *order).withColumn("category", F.lit("High-Confidence Miss"))
    close = pick(found.where("near_even").join(high.select(game), game, "left_anti"), *order).withColumn("category", F.lit("Close-Call Miss"))
    seen = high.select(game).unionByName(close.select(game))
    lost = pick(found.where("dominant_loss").join(seen, game, "left_anti"), *order).withColumn("category", F.lit("Possession-Dominant Loss"))
    return high.unionByName(close).unionByName(lost)
