"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents' tokens are summed by source, language and topic once, into a table of
cells, a row for each combination. Targets are tables too, a row a value, of any number; all values
of a dimension without one are one value, ``other``. Raking multiplies the cells' weights until the token
shares of every source, language and topic are the targets'. A cell's weight, scaled so that the
largest is 1, is the probability of keeping each of its documents; draws are by
a hash of the id, so that they repeat. Only sums over a dimension come to the driver.

Targets are renormalised over the values that have tokens: what is absent
cannot be weighted up. Null sources, languages and topics count as ``other``,
as do values without a target; where the targets leave ``other`` nothing, it keeps
its own share of the tokens and the targets divide the rest, so that no document
is lost for its name. A target for ``other``, also of 0, is taken as it is.
Targets that ``ROUNDS`` rounds do not meet give a warning.

Null and empty texts have no tokens and are drawn with their cell's
probability; texts of any length are counted whole; repeated rows are drawn
alike, and so are the documents of a cell, so that ties need no order. The
added columns take the place of columns of their names; ``prefix`` names them
apart. Other columns are kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, checkpointed

OTHER = "other"
#: Rounds at most; where a target leaves this little it leaves nothing; and the relative change that ends the rounds.
ROUNDS, SETTLED, CLOSE = 50, 1e-6, 1e-5
#: Cells that are broadcast to the documents, at most; more meet them by a shuffle, each in ``SALTS`` places, so that a hot cell's documents spread.
BROADCAST_CELLS, SALTS = 1 << 18, 32
#: Cells up to here are raked in one task.
FEW_CELLS = 1 << 16

Targets = dict[str, dict[str, float] | DataFrame]  # by dimension, the share of each value; a table has value and share


def tokens(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic, by the form of a text: tables, contacts, figures, notices, or prose."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(text, F.lit(" | ")), "tables")
        .when(F.contains(text, F.lit("@")), "contacts")
        .when(text.rlike("[0-9]{9}"), "figures")
        .when(text.rlike("(?i)licen[cs]e|copyright"), "notices")
        .otherwise("prose")
    )


def cells_of(docs: DataFrame, dimensions: dict[str, Column], text_col: str = "text") -> DataFrame:
    """(dimensions, n_tokens): the tokens of every combination of values."""
    own = {d: c.cast("string").alias(d) for d, c in dimensions.items()}
    rows = docs.select(*own.values(), tokens(F.col(f"`{text_col}`")).alias("__n"))
    return checkpointed(rows.groupBy(*dimensions).agg(F.sum("__n").alias("n_tokens")))


def shares(cells: DataFrame, dimension: str) -> DataFrame:
    """(value, share): the token shares of the values of a dimension."""
    total = cells.agg(F.sum("n_tokens")).first()[0] or 1
    named = cells.where(F.col(dimension).isNotNull() & (F.col(dimension) != OTHER)).groupBy(F.col(dimension).alias("value"))
    return named.agg((F.sum("n_tokens") / F.lit(total)).alias("share")).where("share > 0")


def alike(cells: DataFrame, dimension: str) -> DataFrame:
    """Targets of one share each for all values, which together keep theirs."""
    found = shares(cells, dimension)
    whole = found.agg(F.sum("share"), F.count("*")).first()
    return found.withColumn("share", F.lit((whole[0] or 0.0) / max(whole[1], 1)))


def tempered(cells: DataFrame, power: float) -> Targets:
    """Targets that are the values' own token shares to a power, renormalised; below 1 it lifts the small. Rows without a value are one value."""
    out: Targets = {}
    for d in (c for c in cells.columns if c != "n_tokens"):
        own = shares(cells, d)
        whole = own.agg(F.sum("share"), F.sum(F.pow("share", F.lit(power)))).first()
        rest = max(0.0, 1 - (whole[0] or 0.0))
        scale = ((whole[1] or 0.0) + (rest**power if rest > SETTLED else 0.0)) or 1.0
        out[d] = own.withColumn("share", F.pow("share", F.lit(power)) / scale)
    return out


def _table(cells: DataFrame, targets: dict[str, float] | DataFrame) -> DataFrame:
    if isinstance(targets, DataFrame):
        return targets.select("value", "share")
    return cells.sparkSession.createDataFrame(list(targets.items()), "value string, share double")


def _wanted(folded: DataFrame, dimension: str, targets: DataFrame, total: int) -> DataFrame:
    """(dimension, want): the share each value of ``folded`` is to have."""
    own = folded.groupBy(dimension).agg(F.sum("n_tokens").alias("n")).where("n > 0")
    both = own.join(targets, F.col(dimension) == F.col("value"), "left")
    is_other = F.col(dimension) == OTHER
    of = both.agg(F.sum("share").alias("given"), F.max(F.when(is_other, F.col("n"))).alias("other"), F.count("*").alias("held")).first()
    asked = targets.agg(F.sum("share").alias("all"), F.max(F.col("value") == OTHER).alias("other")).first()
    given, scale, rest = of.given or 0.0, 1.0, 0.0
    if of.other is not None:
        rest = max(0.0, 1 - (asked["all"] or 0.0))
        if not asked.other and rest < SETTLED:
            rest = of.other / total
            scale = (1 - rest) / given if given else 0.0
    whole = given * scale + rest
    want = (F.coalesce("share", F.lit(0.0)) * scale + F.when(is_other, F.lit(rest)).otherwise(0.0)) / F.lit(whole) if whole else F.lit(1.0 / max(of.held, 1))
    return both.select(dimension, want.alias(f"want_{dimension}"))


def rake(cells: DataFrame, targets: Targets) -> DataFrame:
    """``cells`` (the dimensions and n_tokens, one row a cell) with weight, the factor that gives every dimension its targets' shares."""
    p, names = apart(cells), list(targets)
    total = cells.agg(F.sum("n_tokens")).first()[0] or 0
    if not total:
        return cells.withColumn("weight", F.lit(1.0))
    tables, named = {d: _table(cells, targets[d]) for d in names}, cells
    for d in names:
        known = tables[d].select(F.col("value").alias(f"{p}{d}"))
        named = named.join(known, F.col(d) == F.col(f"{p}{d}"), "left").withColumn(f"{p}{d}", F.coalesce(f"{p}{d}", F.lit(OTHER)))
    named = checkpointed(named)
    folded = named.groupBy(*(F.col(f"{p}{d}").alias(d) for d in names)).agg(F.sum("n_tokens").alias("n_tokens"))
    folded = checkpointed(folded.coalesce(1) if cells.count() <= FEW_CELLS else folded)
    state = folded
    for d in names:
        state = state.join(_wanted(folded, d, tables[d], total), d, "left")
    state = checkpointed(state.withColumns({"weight": F.lit(1.0), "moved": F.lit(0.0)}))
    for _ in range(ROUNDS):
        now = state.withColumn("moved", F.lit(0.0))
        for d in names:
            sums = now.groupBy(d).agg(F.sum(F.col("n_tokens") * F.col("weight")).alias("held"))
            ratio = F.when(F.col("held") > 0, F.coalesce(f"want_{d}", F.lit(0.0)) * total / F.col("held")).otherwise(1.0)
            now = now.join(sums, d).withColumn("ratio", ratio).withColumns({"weight": F.col("weight") * F.col("ratio"), "moved": F.greatest("moved", F.when(F.col("held") > 0, F.abs(F.col("ratio") - 1)).otherwise(0.0))}).drop("held", "ratio")
        state = checkpointed(now)
        moved = state.agg(F.max("moved")).first()[0]
        if moved < CLOSE:
            break
    else:
        warnings.warn(f"after {ROUNDS} rounds shares still move by {moved:.2g} of themselves", stacklevel=2)
    weights = state.select(*(F.col(d).alias(f"{p}{d}") for d in names), "weight")
    return checkpointed(named.join(weights, [f"{p}{d}" for d in names]).select(*cells.columns, "weight"))


def mixed(
    docs: DataFrame, targets: Targets, dimensions: dict[str, Column], cells: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, prefix: str = ""
) -> DataFrame:
    """``docs`` with n_tokens, cell_weight (the raked factor), probability and sampled, their names after ``prefix``.

    ``dimensions`` gives each target's column of ``docs``; ``cells`` is ``cells_of`` them, if it is known.
    """
    cells = cells_of(docs, dimensions, text_col) if cells is None else cells
    raked = rake(cells, targets)
    size = raked.agg(F.max(F.when(F.col("n_tokens") > 0, F.col("weight"))).alias("top"), F.count("*").alias("n")).first()
    p = apart(docs)
    draw = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(f"mix {seed}")), F.lit(1 << 40)) / float(1 << 40)
    own = {f"{p}{d}": c.cast("string") for d, c in dimensions.items()} | {f"{p}n": tokens(F.col(f"`{text_col}`")), f"{p}draw": draw}
    few = size.n <= BROADCAST_CELLS
    rows = docs.withColumns(own if few else own | {f"{p}salt": F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.lit(SALTS))})
    known = raked.select(*(F.col(d).alias(f"{p}cell_{d}") for d in dimensions), F.col("weight").alias(f"{p}weight"))
    same = [F.col(f"{p}{d}").eqNullSafe(F.col(f"{p}cell_{d}")) for d in dimensions]
    if few:
        known = F.broadcast(known)
    else:
        known = known.withColumn(f"{p}cell_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        same.append(F.col(f"{p}salt") == F.col(f"{p}cell_salt"))
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    weight = F.coalesce(f"{p}weight", F.lit(1.0))
    probability = F.least(weight / (size.top or 1.0), F.lit(1.0))
    added = {"n_tokens": F.col(f"{p}n"), "cell_weight": weight, "probability": probability, "sampled": F.col(f"{p}draw") < probability}
    names = {prefix + k: c for k, c in added.items()}
    return rows.join(known, condition, "left").select(*(F.col(f"`{c}`") for c in docs.columns if c not in names), *(c.alias(k) for k, c in names.items()))


#: Targets of the registered query beside its sources: English at most three fifths, all topics near their usual share.
TARGETS: dict[str, dict[str, float]] = {
    "lang": {"en": 0.58, "fr": 0.16, "de": 0.16, "es": 0.1},
    "topic": {"prose": 0.9, "contacts": 0.025, "figures": 0.025, "notices": 0.03, "tables": 0.02},
}


def corpus_mix(docs: DataFrame, targets: Targets = TARGETS) -> DataFrame:
    """``mixed`` over the corpus' own source and lang and the texts' topics; sources are weighed alike unless they have targets."""
    dimensions = {"source": docs["source"], "lang": docs["lang"], "topic": topic(docs["text"])}
    cells = cells_of(docs, dimensions)
    return mixed(docs, {"source": alike(cells, "source")} | targets, dimensions, cells)
