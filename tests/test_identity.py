"""Name resolution against a comparison of all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from shiftframe.functions import names
from shiftframe.operators import identity


def spread(normal):
    words = normal.split()
    return (words[0], words[-1]) if len(words) > 1 else (normal, "")


def variants(first, normal):
    found = {first} | ({first[:3]} if len(first) >= 3 else set()) | ({first[:4]} if len(first) >= 4 else set())
    for group in names.NICKNAMES:
        if first in group:
            found |= set(group)
    initials = "".join(w[0] for w in normal.split()[:-1])
    return found | ({initials} if len(initials) >= 2 else set())


def similarity(a, b):
    if not a or not b:
        return 0.0
    return 1.0 if a == b or len(a) >= 3 and (a.startswith(b) or b.startswith(a)) else SequenceMatcher(None, a, b).ratio()


def plain(asked, people):
    """key -> (id, sim, verdict), every name against every person."""
    found = {}
    for key, name in asked:
        first, last = spread(name)
        if not last:
            continue
        same = [i for i, n in people if n.replace(" ", "") == name.replace(" ", "")]
        if same:
            found[key] = (min(same), 1.5, "exact")
            continue
        for other in [last] + [last + "n"] * last.endswith("man") + [last[:-3] + "sen"] * last.endswith("son"):
            block = [(i, spread(n)[0]) for i, n in people if spread(n)[1] == other]
            if block:
                break
        ranked = sorted(((max(similarity(v, f) for v in variants(first, name)), -i) for i, f in block), reverse=True)
        if not ranked:
            continue
        top, ahead = ranked[0][0], len(ranked) == 1 or ranked[0][0] - ranked[1][0] >= 0.2
        verdict = "high" if top >= 0.92 else "good" if top >= 0.8 else "margin" if top >= 0.55 and ahead else None
        if verdict:
            found[key] = (-ranked[0][1], round(top, 9), verdict)
    return found


@pytest.mark.parametrize("seed,hot", [(1, 0.0), (2, 0.4)])
def test_resolution_equals_all_pairs(spark, seed, hot):
    """With ``hot`` that share of all people and names has one last name."""
    random.seed(seed)
    firsts = ["mike", "michael", "chris", "christopher", "al", "alexander", "sasha", "jo", "joseph", "joe", "nils", "niels", "kara", "karla", "carla", "t", "bo", "zed", "jean luc", "p a"]
    lasts = ["smith", "grossmann", "jansen", "lee", "oneill", "kim", "ericsen", "ericson"]
    last = lambda: "hotname" if random.random() < hot else random.choice(lasts)
    people = [(k, f"{random.choice(firsts)} {last()}") for k in range(250)] + [(900, "solo"), (901, "")]
    misspelt = lambda n: "".join(c for c in n if random.random() > 0.12)
    asked = [(k, misspelt(random.choice(firsts)) + " " + random.choice(["grossman", "janson", "absent", last(), last()])) for k in range(200)] + [(500, "solo"), (501, ""), (502, None)]
    asked = [(k, n if n is None else " ".join(n.split())) for k, n in asked]
    a = spark.createDataFrame(asked, "key long, name string").repartition(3)
    b = spark.createDataFrame(people, "id long, name string").repartition(3)
    normal = {r.key: r.n for r in a.select("key", names.normalize_name_strict(F.col("name")).alias("n")).collect()}
    known = [(r.id, r.n) for r in b.select("id", names.normalize_name_strict(F.col("name")).alias("n")).collect()]
    want = plain(list(normal.items()), known)
    found = {r.key: (r.id, round(r.sim, 9), r.verdict) for r in identity.resolved_names(a, b, "key", "id").collect()}
    assert found == want and {v for _, _, v in want.values()} >= {"exact", "high", "good"} | ({"margin"} if not hot else set())


def test_only_the_two_best_of_a_block_go_on(spark):
    """Candidates grow with the names, not with the pairs of a block."""
    people = spark.range(3000).select("id", F.concat(F.lit("q"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(" hotname")).alias("name"))
    asked = spark.range(40).select(F.col("id").alias("key"), F.concat(F.lit("zz"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(" hotname")).alias("name"))
    known = identity.known_names(people, "id", "name")
    blocks = identity.last_name_blocks(identity.asked_names(asked, "key", "name"), known)
    assert identity.candidates(blocks, known).count() == 80


def test_lookup_keys_take_whole_last_names(spark):
    people = spark.createDataFrame([(1, "james", "van riemsdyk"), (2, "", "lee"), (3, "solo", ""), (4, "jack", "van riemsdyk")], "id long, first string, last string")
    found = {r.name_key: r.id for r in identity.name_lookup(people, "id", "first", "last").collect()}
    assert found == {"james van riemsdyk": 1, "jack van riemsdyk": 4, "j van riemsdyk": 4}


@pytest.mark.parametrize("names,shares", [(60, 1.0), (3000, 0.02)])
def test_two_best_equal_all_and_few_are_compared(monkeypatch, names, shares):
    """Names' bounds tell which can be among the two best; before, every pair of a block was compared."""
    random.seed(names)
    word = lambda: "".join(random.choice("etaoinsrhl") for _ in range(random.randint(1, 9)))
    firsts = list(dict.fromkeys(["", *(word() for _ in range(names))]))
    lows = random.sample(range(10 * names), len(firsts))
    highs = [i + random.choice([0, 0, 10 * names]) for i in lows]
    variants = [["x" + f] for f in random.sample(firsts[1:], 10)] + [[word(), word(), ""] for _ in range(20)] + [[]]
    want = [sorted([(-max((similarity(v, f) for v in own), default=0.0), i) for f, low, high in zip(firsts, lows, highs, strict=True) for i in {low, high}])[:2] for own in variants]
    calls = []
    monkeypatch.setattr(identity, "matched_ratio", lambda a, b: calls.append(1) or SequenceMatcher(None, a, b).ratio())
    found = list(identity.two_best(variants, firsts, lows, highs))
    assert [[(-s, i) for s, i in two] for two in found] == want
    assert len(calls) <= shares * len(firsts) * sum(map(len, variants))


def test_blocks_in_pieces_give_the_same(spark, monkeypatch):
    people = spark.range(300).select("id", F.concat(F.translate(F.hex(F.xxhash64("id")), "0123456789", "abcdefghij"), F.lit(" hotname")).alias("name"))
    asked = spark.range(40).select(F.col("id").alias("key"), F.concat(F.lit("zz"), F.translate(F.hex(F.xxhash64(F.col("id") + 3)), "0123456789", "abcdefghij"), F.lit(" hotname")).alias("name"))
    rows = lambda: sorted(map(tuple, identity.resolved_names(asked, people, "key", "id").collect()))
    whole = rows()
    monkeypatch.setattr(identity, "ASKED", 7)
    monkeypatch.setattr(identity, "KNOWN", 11)
    assert rows() == whole and len(whole) > 30


def test_names_are_normalised_once(spark):
    """What joins and counts them reads a written table."""
    people = spark.range(20).select("id", F.concat(F.lit("a b"), F.col("id").cast("string")).alias("name"))
    asked = people.withColumnRenamed("id", "key")
    for sure in (False, True):
        plan = identity.resolved_names(asked, people, "key", "id", sure=sure)._jdf.queryExecution().optimizedPlan().toString()
        assert "Range (" not in plan
