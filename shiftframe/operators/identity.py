"""Player identity: lookups by name and id in a cascade, and the acceptance of approximate matches."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from shiftframe.functions.names import first_and_last, first_name_variants, last_name_spellings, lookup_keys, matched_ratio, normalize_name_strict, same_first_name

from .checkpoints import checkpointed
from .grouping import primary_row

ASKED, KNOWN = 128, 2048  # names of a block that are compared at once


def name_lookup(people: DataFrame, id_col: str, first_col: str, last_col: str) -> DataFrame:
    """(name_key, id): each lookup key of the normal first and last names with the greatest id that has it."""
    keys = people.select(F.col(id_col), F.explode(lookup_keys(F.col(first_col), F.col(last_col))).alias("name_key"))
    return keys.groupBy("name_key").agg(F.max(id_col).alias(id_col))


def unique_names(people: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """(name, id) of the names that one id alone has."""
    return people.where(F.col(name_col) != "").groupBy(name_col).agg(F.min(id_col).alias(id_col), F.count_distinct(id_col).alias("n")).where("n = 1").drop("n")


def id_cascade(rows: DataFrame, steps: list[tuple[DataFrame, str]], id_col: str) -> DataFrame:
    """``rows`` with id and the number of the first step that knows it; each step is (table, its key column)."""
    found, ids = rows, []
    for k, (known, key) in enumerate(steps):
        found = found.join(known.select(F.col(key), F.col(id_col).alias(f"__id{k}")), key, "left")
        ids.append(F.col(f"__id{k}"))
    step = F.coalesce(*(F.when(x.isNotNull(), F.lit(k + 1)) for k, x in enumerate(ids)))
    return found.withColumns({id_col: F.coalesce(*ids), "step": step}).drop(*(f"__id{k}" for k in range(len(steps))))


def accepted(candidates: DataFrame, keys: list[str], sim: str, tie: Column) -> DataFrame:
    """The best candidate of each key, if its similarity settles it: 0.92 or more ("high"), 0.8 or more
    ("good"), or 0.55 or more for a sole candidate or one 0.2 ahead of the next ("margin")."""
    order = Window.partitionBy(*keys).orderBy(F.desc(sim), tie)
    ranked = candidates.withColumns({"__k": F.row_number().over(order), "__next": F.lead(sim).over(order)})
    s, ahead = F.col(sim), F.col("__next").isNull() | (F.col(sim) - F.col("__next") >= 0.2)
    verdict = F.when(s >= 0.92, "high").when(s >= 0.8, "good").when((s >= 0.55) & ahead, "margin")
    return ranked.where("__k = 1").withColumn("verdict", verdict).where("verdict is not null").drop("__k", "__next")


def deduplicated_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return primary_row(rows, keys, order)


def _spaceless(normal: Column) -> Column:
    return F.replace(normal, F.lit(" "))


def normal_names(people: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """(id, normal), written once: what reads them does not normalise again, which takes longer than all joins of the names."""
    return checkpointed(people.select(F.col(id_col).alias("id"), normalize_name_strict(F.col(name_col)).alias("normal")))


def by_last_name(normal: DataFrame) -> DataFrame:
    """(last, first, low, high, n): people, who have id and normal, by first and last word, with the least and greatest of their ids."""
    first, last = first_and_last(F.col("normal"))
    return normal.select("id", first.alias("first"), last.alias("last")).where("last <> ''").groupBy("last", "first").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count_distinct("id").alias("n"))


def known_names(people: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """``by_last_name`` of the people's normal names."""
    return by_last_name(normal_names(people, id_col, name_col))


def asked_names(asked: DataFrame, key_col: str, name_col: str) -> DataFrame:
    """(normal, first, last, variants) of the names asked for, once each, that have a last name."""
    return spelt_names(asked.select(normalize_name_strict(F.col(name_col)).alias("normal")))


def spelt_names(normal: DataFrame) -> DataFrame:
    """``asked_names`` of names that are normal."""
    first, last = first_and_last(F.col("normal"))
    return normal.select("normal").distinct().select("normal", first.alias("first"), last.alias("last"), first_name_variants(first, F.col("normal")).alias("variants")).where("last <> ''")


def last_name_blocks(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``asked`` with block: the first spelling of the last name that anyone of ``known`` has; names without one are left out."""
    tried = asked.select("*", F.posexplode(last_name_spellings(F.col("last"))).alias("at", "block"))
    met = tried.join(known.select(F.col("last").alias("block")).distinct(), "block")
    best = met.groupBy("normal").agg(F.min_by("block", "at").alias("block"))
    return asked.join(best, "normal")


def alike_candidates(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """(normal, id): the least id of those in the block whose first name is alike.

    Alike names share their first letters, up to three: they meet by last name and those, not all of a block.
    """
    begun = F.filter(F.array_distinct(F.flatten(F.transform("variants", lambda v: F.transform(F.sequence(F.lit(1), F.least(F.length(v), F.lit(3))), lambda k: F.substring(v, F.lit(1), k))))), lambda x: x != "")
    tried = blocks.where("size(variants) > 0").select("normal", "variants", F.col("block").alias("last"), F.explode(begun).alias("begin"))
    met = tried.join(known.select("last", "first", "low", F.substring("first", 1, 3).alias("begin")), ["last", "begin"])
    return met.where(same_first_name(F.col("variants"), F.col("first"))).groupBy("normal").agg(F.min("low").alias("id"))


def two_best(variants: list[list[str]], firsts: list[str], lows: list, highs: list) -> Iterator[list[tuple[float, object]]]:
    """For each name asked for, the (similarity, id) of its two best of the known first names; of equal ones the least ids.

    Letters that two names share, wherever they stand, bound their matched ratio. Names are compared by falling bounds until none can be among the two best.
    """
    codes = np.frombuffer("".join(firsts).encode("utf-32-le"), np.uint32)
    length = np.array([len(f) for f in firsts])
    letters, at = np.unique(codes, return_inverse=True)
    counts = np.bincount(at * len(firsts) + np.repeat(np.arange(len(firsts)), length), minlength=len(letters) * len(firsts)).astype(np.int16).reshape(len(letters), -1)
    table = {chr(c): n for c, n in zip(letters.tolist(), counts, strict=True)}
    order = sorted(range(len(firsts)), key=firsts.__getitem__)
    ordered = [firsts[k] for k in order]
    least = lambda x: (x is not None, x)  # noqa: E731  null ids first

    def beginning(x: str) -> list[int]:
        """The known names that ``x`` equals or, of three letters or more, begins or begins with."""
        longer = order[bisect_left(ordered, x) : bisect_left(ordered, x + "\U0010ffff")] if len(x) >= 3 else []
        shorter = [p for p in range(1, len(x) + 1) if p == len(x) or len(x) >= 3]
        return [*longer, *(k for p in shorter for k in order[bisect_left(ordered, x[:p]) : bisect_left(ordered, x[:p] + "\0")])]

    for own in variants:
        own = [x for x in own if x]
        bounds = np.zeros((len(own) + 1, len(firsts)))  # the last row: alike names
        for row, x in zip(bounds, own, strict=False):
            shared = sum((np.minimum(table[c], n) for c, n in Counter(x).items() if c in table), np.zeros(len(firsts), np.int16))
            row[:] = 2.0 * shared / (len(x) + length)
            bounds[-1, beginning(x)] = 1.0
        bound, found = bounds.max(0), []
        top = np.argpartition(-bound, 15)[:16] if len(bound) > 64 else np.arange(len(bound))

        def compare(places: np.ndarray) -> None:
            for k in places[np.argsort(-bound[places], kind="stable")].tolist():  # noqa: B023
                if len(found) == 2 and (-bound[k], least(lows[k])) > found[1][:2]:  # noqa: B023
                    if -bound[k] > found[1][0]:  # noqa: B023
                        break
                    continue
                sim = float(bounds[-1, k])  # noqa: B023
                for v in np.argsort(-bounds[:-1, k], kind="stable").tolist():  # noqa: B023
                    if bounds[v, k] <= sim:  # noqa: B023
                        break
                    sim = max(sim, matched_ratio(own[v], firsts[k]))  # noqa: B023
                for i in {lows[k], highs[k]}:
                    found.append((-sim, least(i), i))  # noqa: B023
                found.sort(key=lambda f: f[:2])  # noqa: B023
                del found[2:]  # noqa: B023

        compare(top)
        if len(top) < len(bound):
            rest = bound >= -found[1][0] if len(found) == 2 else np.ones(len(bound), bool)
            rest[top] = False
            compare(np.nonzero(rest)[0])
        yield [(-sim, i) for sim, _, i in found]


def candidates(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """(normal, id, sim): the two best of each name's block; people of one first and last name count as two at most.

    A block is cut into pieces of about ``ASKED`` names asked for and ``KNOWN`` known ones, of which each pair is compared at
    once, anywhere, so that no task holds a block. Pairs of names stay within ``two_best``, which computes few of their similarities.
    """
    cut = lambda n, size: F.ceil(F.count("*") / size).alias(n)
    sizes = blocks.groupBy(F.col("block").alias("last")).agg(cut("asked", ASKED)).join(known.groupBy("last").agg(cut("known", KNOWN)), "last")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    piece = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    asked = blocks.select(F.col("block").alias("last"), "normal", "variants").join(sizes, "last").groupBy("last", "known", piece("normal", "asked").alias("i")).agg(F.collect_list(F.struct("normal", "variants")).alias("names"))
    people = known.join(sizes, "last").groupBy("last", "asked", piece("first", "known").alias("j")).agg(F.collect_list(F.struct("first", "low", "high")).alias("people"))
    keys, tasks = ["last", "i", "j"], int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.select("last", "i", every("known").alias("j"), "names").repartition(tasks, *keys)
    people = people.select("last", every("asked").alias("i"), "j", "people").repartition(tasks, *keys)
    met = asked.join(people, keys).select(*(F.col(c).alias(c.rpartition(".")[2]) for c in ("names.normal", "names.variants", "people.first", "people.low", "people.high")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                normal, variants, first, low, high = (b.column(c)[k].as_py() for c in ("normal", "variants", "first", "low", "high"))
                found = [(n, i, sim) for n, two in zip(normal, two_best(variants, first, low, high), strict=True) for sim, i in two]
                names, ids, sims = zip(*found, strict=True)
                yield pa.record_batch({"normal": pa.array(names, pa.string()), "id": pa.array(ids, b.schema.field("low").type.value_type), "sim": pa.array(sims, pa.float64())})

    schema = StructType([StructField("normal", known.schema["last"].dataType), StructField("id", known.schema["low"].dataType), StructField("sim", DoubleType())])
    order = Window.partitionBy("normal").orderBy(F.desc("sim"), "id")
    return met.mapInArrow(compare, schema).withColumn("__k", F.row_number().over(order)).where("__k <= 2").drop("__k")


def resolved_names(asked: DataFrame, people: DataFrame, key_col: str, id_col: str, asked_name: str = "name", people_name: str = "name", sure: bool = False) -> DataFrame:
    """(key, id, sim, verdict): the person that each name asked for is taken to be, where one can be told.

    Names that are equal, but for spaces, come first (sim 1.5, "exact"). Of the others only people of the same last name, or
    of the first other spelling of it that anyone has, are candidates, and their first names decide: alike ("high") or, by the best matched ratio of
    any variant, as ``accepted`` says. Each step sees only what those before it leave; ties go to the least id. Names asked for
    and known are counted by spelling first, so that a frequent name is compared once. ``sure`` gives those of similarity 1 or
    more alone, which need no ratio: of a name that is not alike it is less.
    """
    normal, keyed = normal_names(people, id_col, people_name), normal_names(asked, key_col, asked_name)
    names, known = spelt_names(keyed), checkpointed(by_last_name(normal).drop("n"))  # read by each step
    whole = normal.select(_spaceless(F.col("normal")).alias("flat"), "id").groupBy("flat").agg(F.min("id").alias("id"))
    exact = names.select("normal", _spaceless(F.col("normal")).alias("flat")).join(whole, "flat").select("normal", "id", F.lit(1.5).alias("sim"), F.lit("exact").alias("verdict"))
    blocks = last_name_blocks(names.join(exact, "normal", "left_anti"), known)
    alike = alike_candidates(blocks, known).select("normal", "id", F.lit(1.0).alias("sim"), F.lit("high").alias("verdict"))
    found = exact.unionByName(alike)
    if not sure:
        rest = accepted(candidates(blocks.join(alike, "normal", "left_anti"), known), ["normal"], "sim", F.asc("id"))
        found = found.unionByName(rest.select("normal", "id", "sim", "verdict"))
    return keyed.select(F.col("id").alias(key_col), "normal").join(found, "normal").select(key_col, F.col("id").alias(id_col), "sim", "verdict")
