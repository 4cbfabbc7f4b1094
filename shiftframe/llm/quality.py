"""Quality rules as weak supervision, in DataFrame operations only.

Each rule votes good (1), bad (-1) or abstains (0) on a text's measures.
Expectation-maximisation estimates each rule's accuracies, on good and on bad
texts, and the share of good texts, from the votes alone: given the accuracies,
a text's posterior follows from its votes; given the posteriors, the accuracies
are the shares of the votes. A rule that says good of almost any text thus
weighs little when it says so and much when it does not. A text is kept for its
posterior, not for passing every rule.

The estimation runs over distinct vote patterns with their counts: at most
3 ** rules rows, whatever the number of texts. Words are runs of characters
other than the six ASCII white spaces.

Null and empty texts have no words and zero measures, and get votes like
others; repeated rows count each; texts of the same votes tie, with one
posterior, and the threshold itself counts as good; texts of any length are
measured whole, in arrays of their words; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS, SETTLED = 40, 1e-5
#: To start from: the share of good texts, and the shares of votes on good and on bad texts.
PRIOR = 0.85
VOTES = (1, 0, -1)
ON_GOOD, ON_BAD = (0.93, 0.05, 0.02), (0.6, 0.2, 0.2)
SMOOTH = 1e-3  # of all texts, added to each count of votes


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rules() -> dict[str, Column]:
    """Votes by rule: bad if the first condition holds, else good if the second does."""
    n = F.col("n_words")
    return {
        "length": _vote(n < 50, n >= 80),
        "repeats": _vote(_share("n_repeat_words", "n_words") > 0.5, _share("n_repeat_words", "n_words") < 0.2),
        "lines": _vote(_share("n_dup_lines", "n_lines") > 0.3, _share("n_dup_lines", "n_lines") < 0.1),
        "symbols": _vote(_share("n_symbols", "n_words") > 0.3, _share("n_symbols", "n_words") < 0.05),
        "marked_words": _vote(_share("n_marked", "n_words") > 0.1, _share("n_marked", "n_words") < 0.02),
        "word_length": _vote((_share("word_chars", "n_words") < 2.5) | (_share("word_chars", "n_words") > 12), _share("word_chars", "n_words").between(3, 10)),
        "capitals": _vote(_share("n_capitals", "word_chars") > 0.4, _share("n_capitals", "word_chars") < 0.15),
        "sentences": _vote(_share("n_sentences", "n_words") < 0.005, _share("n_sentences", "n_words").between(0.02, 0.3)),
    }


def _held(value: Column, use) -> Column:
    """``use(value)``, the value being computed once though used many times."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in a three-word window that occurs twice or more in the text.

    Windows' hashes are sorted with their places; equal neighbours are repeats.
    The repeats' places, in order, then cover three words each, overlaps once.
    """
    n = F.size(words) - 2
    windows = F.arrays_zip(F.slice(words, 1, n).alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c"))
    placed = F.sort_array(F.transform(windows, lambda w, k: F.struct(F.xxhash64(w["a"], w["b"], w["c"]).alias("h"), k.alias("k"))))
    equal = lambda s, x, k: (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h)
    repeats = _held(placed, lambda s: F.transform(F.filter(s, lambda x, k: F.coalesce(equal(s, x, k), F.lit(False))), lambda x: x.k))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(F.sort_array(repeats), start, lambda a, k: F.struct((a.n + F.least(F.lit(3), k - a.last)).alias("n"), k.alias("last")), lambda a: a.n)
    return F.when(n < 2, F.lit(0).cast("long")).otherwise(covered)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_marked, n_capitals, n_sentences)."""
    text = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    rows = text.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("lines", lines)
    chars = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    return rows.select(
        id_col,
        F.size("words").cast("long").alias("n_words"),
        chars.alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>](?=[\x20\x09-\x0D]|$)")).cast("long").alias("n_marked"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit(r"[.!?](?=[\x20\x09-\x0D]|$)")).cast("long").alias("n_sentences"),
    )


Accuracies = dict[str, tuple[tuple[float, ...], tuple[float, ...]]]  # by rule, shares of VOTES on good and on bad texts


def posterior(accuracies: Accuracies, prior: float) -> Column:
    """The probability that a text with the votes in the columns ``accuracies`` names is good."""
    log_odds = F.lit(math.log(prior / (1 - prior)))
    for rule, (good, bad) in accuracies.items():
        weight = [F.lit(math.log(g / b)) for g, b in zip(good, bad, strict=True)]
        log_odds = log_odds + F.when(F.col(rule) == 1, weight[0]).when(F.col(rule) == 0, weight[1]).otherwise(weight[2])
    return 1 / (1 + F.exp(-log_odds))


def estimate(votes: DataFrame, names: list[str]) -> tuple[Accuracies, float]:
    """Accuracies by rule and the share of good texts, by expectation-maximisation over vote patterns."""
    patterns = checkpointed(votes.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1))  # few rows: 3 ** rules at most
    accuracies, prior = dict.fromkeys(names, (ON_GOOD, ON_BAD)), PRIOR
    counts = [F.sum(F.when(F.col(r) == v, F.col("n") * F.col(c)).otherwise(0.0)).alias(f"{r} {v} {c}") for r in names for v in VOTES for c in ("good", "bad")]
    for _ in range(ROUNDS):
        weighed = patterns.withColumn("good", posterior(accuracies, prior)).withColumn("bad", 1 - F.col("good"))
        sums = weighed.agg(F.sum(F.col("good") * F.col("n")).alias("good"), F.sum("n").alias("all"), *counts).first()
        if not sums["all"]:
            break
        extra = SMOOTH * sums["all"]
        shares = lambda r, c: tuple(x / t for xs in [[sums[f"{r} {v} {c}"] + extra for v in VOTES]] for t in [sum(xs)] for x in xs)  # noqa: E731, B023
        accuracies, before = {r: (shares(r, "good"), shares(r, "bad")) for r in names}, prior
        prior = min(0.999, max(0.001, sums["good"] / sums["all"]))
        if abs(prior - before) < SETTLED:
            break
    return accuracies, prior


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Measures, votes by rule, quality (the posterior), base_failed and kept for every text."""
    voted = checkpointed(measures(docs, id_col, text_col).withColumns(rules()))
    accuracies, prior = estimate(voted, list(rules()))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("quality", posterior(accuracies, prior)).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
