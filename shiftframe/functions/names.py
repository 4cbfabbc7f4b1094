"""Person names: normal forms, lookup keys, aliases, variants and match scores."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Interchangeable first names, one group a line.
NICKNAMES = (
    ("michael", "mike"),
    ("nicholas", "nick"),
    ("christopher", "chris"),
    ("jacob", "jake"),
    ("alexander", "alex", "sasha"),
    ("matthew", "matt"),
    ("jonathan", "jon", "john"),
    ("william", "will", "bill"),
    ("anthony", "tony"),
    ("joseph", "joe"),
    ("patrick", "pat"),
    ("timothy", "tim"),
    ("benjamin", "ben"),
    ("cristovel", "boo"),
)
# Last names by another spelling (hyphens for spaces), and first names by last name.
LAST_ALIASES = {"zuccarello-aasen": "zuccarello", "grossman": "grossmann", "blueger": "blueger"}
FIRST_ALIASES = {"blueger": {"theodor": "teddy"}}


def _folds() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition makes of the characters of the basic plane, in lower case.

    Characters of one ASCII character as two aligned strings, then the combining marks, which have
    no counterpart and so vanish; Latin ligatures of several letters apart.
    """
    one, plain, marks, several = [], [], [], {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x10000)):
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(c)
            continue
        if c.lower() != c:
            continue
        folded = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if len(folded) == 1 and folded.isascii():
            one.append(c)
            plain.append(folded)
        elif folded.isascii() and folded.isalpha() and "LATIN" in unicodedata.name(c, ""):
            several[c] = folded
    return "".join(one + marks), "".join(plain), several


FOLDED, PLAIN, LIGATURES = _folds()


def fold_accents(text: Column) -> Column:
    """Lower case without accents: letters as Unicode decomposes them, combining marks dropped."""
    folded = F.translate(F.lower(text), FOLDED, PLAIN)
    for c, letters in LIGATURES.items():
        folded = F.replace(folded, F.lit(c), F.lit(letters))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(folded)  # ASCII has nothing to fold


def _join_initials(text: Column) -> Column:
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    for _ in range(2):
        text = F.regexp_replace(text, r"\b([a-z])\s+([a-z])\b", "$1$2")
    return F.coalesce(text, F.lit(""))


def _join_prefixes(text: Column) -> Column:
    """O' and D' become one word with what follows."""
    return F.regexp_replace(text, r"(?<![\p{L}\p{N}_])([od])['’]", "$1")


def normalize_name(name: Column) -> Column:
    """Lower-case letters and single spaces; all other signs part words, initials join; null gives ""."""
    text = _join_prefixes(F.regexp_replace(fold_accents(name), r"[.\-]", " "))
    return _join_initials(F.regexp_replace(text, "[^a-z ]", " "))


def normalize_name_strict(name: Column, accents: bool = True) -> Column:
    """Like ``normalize_name``, but only dots, hyphens and apostrophes part words; other signs vanish.

    Without ``accents`` accented letters vanish too, instead of losing their accents. With it only
    ASCII is left when the prefixes join, so that a curly apostrophe is no sign any more.
    """
    text = F.trim(F.lower(name))
    if accents:
        text = F.regexp_replace(fold_accents(text), r"[^\x00-\x7F]", "")
    text = F.regexp_replace(_join_prefixes(text), r"[.\-’']", " ")
    return _join_initials(F.regexp_replace(text, "[^a-z ]", ""))


def lookup_keys(first: Column, last: Column) -> Column:
    """The keys "first last" and "f last" of normal first and whole last names; none if either is empty."""
    keys = F.array_distinct(F.array(F.concat_ws(" ", first, last), F.concat_ws(" ", F.substring(first, 1, 1), last)))
    return F.when((first != "") & (last != ""), keys).otherwise(F.array().cast("array<string>"))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def with_aliases(first: Column, last: Column) -> tuple[Column, Column]:
    """First and last name after the alias tables: the last name's own first, then the first name's for that last name."""
    last = F.coalesce(_lookup(LAST_ALIASES, F.replace(normalize_name_strict(last), F.lit(" "), F.lit("-"))), last)
    own = normalize_name_strict(last)
    for name, table in FIRST_ALIASES.items():
        first = F.when(own == name, F.coalesce(_lookup(table, normalize_name_strict(first)), first)).otherwise(first)
    return first, last


def name_score(a: Column, b: Column) -> Column:
    """How well two normal names agree: 100 equal, 92 but for spaces; with the same last word 90 for the same
    first word, 88 where one first word begins the other, 85 for the same initial when one has two letters or fewer; else 0."""
    wa, wb = F.split(a, " "), F.split(b, " ")
    fa, fb = F.element_at(wa, 1), F.element_at(wb, 1)
    whole = (F.size(wa) >= 2) & (F.size(wb) >= 2) & (F.element_at(wa, -1) == F.element_at(wb, -1))
    return (
        F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0)
        .when(a == b, 100)
        .when(F.replace(a, F.lit(" ")) == F.replace(b, F.lit(" ")), 92)
        .when(~whole, 0)
        .when(fa == fb, 90)
        .when(F.startswith(fa, fb) | F.startswith(fb, fa), 88)
        .when((F.substring(fa, 1, 1) == F.substring(fb, 1, 1)) & (F.least(F.length(fa), F.length(fb)) <= 2), 85)
        .otherwise(0)
    )


def initials(full_name: Column) -> Column:
    """The first letters of all words but the last of a name; "" for one word."""
    words = F.split(normalize_name_strict(full_name), " ")
    return F.array_join(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.substring(w, 1, 1)), "")


def first_name_variants(first: Column, full_name: Column | None = None) -> Column:
    """The name, its first three and four letters, its nicknames, and two or more initials of the full name; in order."""
    groups = {n: [x for x in g if x != n] for g in NICKNAMES for n in g}
    table = F.create_map(*(x for n, g in groups.items() for x in (F.lit(n), F.array(*map(F.lit, g)))))
    found = [first, *(F.when(F.length(first) >= n, F.substring(first, 1, n)) for n in (3, 4))]
    if full_name is not None:
        own = initials(full_name)
        found.append(F.when(F.length(own) >= 2, own))
    nick = F.coalesce(F.try_element_at(table, first), F.array().cast("array<string>"))
    return F.array_sort(F.array_union(F.array_compact(F.array(*found)), nick))


def matched_ratio(a: str, b: str) -> float:
    """The matched-blocks ratio of two strings."""
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def _matched_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else matched_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def first_name_similarity(a: Column, b: Column) -> Column:
    """0 if either is empty, 1 if they are equal or one begins the other (``a`` with three letters or more),
    else the matched-blocks ratio, the only part that leaves the JVM."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    settled = F.when((a == "") | (b == ""), 0.0).when((a == b) | (F.length(a) >= 3) & (F.startswith(a, b) | F.startswith(b, a)), 1.0)
    return F.coalesce(settled, _matched_ratio(F.when(settled.isNull(), a), b))


def first_and_last(normal: Column) -> tuple[Column, Column]:
    """The first and the last word of a normal name; one word has no last name."""
    words = F.split(normal, " ")
    return F.element_at(words, 1), F.when(F.size(words) > 1, F.element_at(words, -1)).otherwise(F.lit(""))


def last_name_spellings(last: Column) -> Column:
    """A normal last name and what it may be misspelt for, in the order to try: -man as -mann, -son as -sen."""
    return F.array_compact(F.array(last, F.when(F.endswith(last, F.lit("man")), F.concat(last, F.lit("n"))), F.when(F.endswith(last, F.lit("son")), F.concat(F.substring(last, F.lit(1), F.length(last) - 3), F.lit("sen")))))


def same_first_name(variants: Column, b: Column) -> Column:
    """True if ``b`` is one of the variants, begins one of three letters or more, or begins with one."""
    return (b != "") & F.exists(variants, lambda v: (v != "") & ((v == b) | (F.length(v) >= 3) & (F.startswith(v, b) | F.startswith(b, v))))
