"""Conversation structure repair: the cheapest edits that give alternating turns, by iterative-deepening A*.

A conversation is well formed if its roles' initials read ``(s?(ua)+)?``. The
edits are Delete (4), Insert of an empty user or assistant message (3), Keep (0)
and Rerole to user or assistant (3); a truncated message that stays costs 3 more,
a blank or repeated one must go. ``search`` tries the edits in the order of their
initials, depth first, below a cost bound that rises to the least cost beyond it;
a table holds what each state is known to need, so that a failed state is entered
again only with more to spend. The first accepted path is the cheapest, and of
those the least in ASCII.

Messages are ranged by conversation and place, so that one conversation may fill
many tasks. A task cuts its part of a long conversation into stretches of
``STRETCH`` messages and searches each from every state to every state; inserts
stand before a message of their own stretch, so that no audit of a stretch begins
another. Costs, and the audits' ranks, then suffice to link stretches: a few numbers
for each hundred messages meet in one task, never the messages.

Only marks and 256-bit hashes of the messages go through this; texts travel once, beside the
decisions, to be written or hashed in order. A null role or text is one space, an
absent text that; rows of a null conversation are one conversation; null turns
come first; messages of one turn are ordered by role, then by their hashes;
repeated rows are duplicates and deleted; a role that is empty has no initial and
cannot be kept. Texts have any length. Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import checkpointed, columns, small_batches

STRETCH = 96
WHITE = " \t\n\x0b\f\r"
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
GOALS = (START, ASSISTANT)
TAILS = ("", "II", "I", "")
PAIRS = [(a, b) for a in range(4) for b in range(4) if b >= min(a, USER)]
NAMES = {"u": "user", "a": "assistant"}


def _next(state: int) -> tuple[str, int]:
    """The role that may follow, user or assistant, and the state after it."""
    return ("a", ASSISTANT) if state == USER else ("u", USER)


def mark(initial: str, forced: bool, cut: bool) -> str:
    """One letter for a message: ``-`` must go; else its initial (``x``: none that may stay), upper case if truncated."""
    if forced:
        return "-"
    found = initial if initial and initial in "sua" else "x"
    return found.upper() if cut else found


def _least(m: str) -> int:
    """What a message costs in any case."""
    return DELETE if m in "-X" else REROLE if m == "x" else CUT if m.isupper() else 0


def _moves(marks: str, i: int, state: int, inserts: bool) -> Iterator[tuple[str, int, int, int]]:
    """Edit, cost, and where it leads, in ASCII order."""
    m = marks[i] if i < len(marks) else ""
    if m:
        yield "D", DELETE, i + 1, state
    if m or inserts:
        yield "I", INSERT, i, _next(state)[1]
    if m and m != "-":
        cut, (wanted, after) = CUT * m.isupper(), _next(state)
        if m.lower() == wanted:
            yield "K", cut, i + 1, after
        elif m.lower() == "s" and state == START:
            yield "K", cut, i + 1, SYSTEM
        yield "R", REROLE + cut, i + 1, after


@functools.lru_cache(maxsize=1 << 14)
def search(marks: str, entry: int = START, goals: tuple[int, ...] = GOALS, inserts: bool = True) -> tuple[int, str] | None:
    """Least cost and audit from ``entry`` to one of ``goals``; ``inserts`` allows them behind the last message. None: no way."""
    if goals == (SYSTEM,) and entry == START and "s" not in marks.lower():
        return None
    least = [0] * (len(marks) + 1)
    for i in range(len(marks) - 1, -1, -1):
        least[i] = least[i + 1] + _least(marks[i])
    needs: dict[tuple[int, int], float] = {}
    path: list[str] = []

    def descend(i: int, state: int, budget: float) -> float:
        """-1 if a goal is reached within the budget, else what is needed at least."""
        need = needs.get((i, state), least[i])
        if need > budget:
            return need
        if i == len(marks) and state in goals:
            return -1
        need = float("inf")
        for edit, cost, j, after in _moves(marks, i, state, inserts):
            path.append(edit)
            got = descend(j, after, budget - cost)
            if got < 0:
                return -1
            path.pop()
            need = min(need, cost + got)
        needs[i, state] = need
        return need

    bound: float = least[0]
    while (got := descend(0, entry, bound)) >= 0:
        bound = got
    return int(bound), "".join(path)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that crc32 of ``conv_id:turn`` chooses."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(fate == 3, 2).otherwise(1)))
    rows = columns(turns, "conv_id", "turn", "role", "text").where(fate != 0)
    return rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _key() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def faults(rows: DataFrame) -> DataFrame:
    """Like messages of a turn as one row: conv_id, turn, role, key, n of them, blank, cut (ends without a stop), new (first of its role and text)."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    marked = rows.select("conv_id", "turn", "role", _key().alias("key"), (F.rtrim(bare, F.lit(WHITE)) == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    alike = marked.groupBy("conv_id", "turn", "role", "key").agg(F.count("*").alias("n"), F.bool_or("blank").alias("blank"), F.bool_or("cut").alias("cut"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = alike.groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min(when).alias("first"))
    joined = alike.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")))
    return joined.select(*alike.columns, (when == F.col("first")).alias("new"))


STRETCHES = """conv_id {0}, part int, seq long, open boolean, marks string, turns array<long>, roles array<string>, keys array<binary>, costs array<long>, audits array<string>, ranks array<int>,
n long, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, n_turns long"""


def _stretch(conv, part: int, seq: int, rows: list[tuple], whole: bool) -> dict:
    """One stretch: its marks, counts, and cheapest edits from each state to each (a whole conversation: from start to goal)."""
    initials = [role[:1] for _, role, _, _, _, _ in rows]
    marks = "".join(mark(a, blank or not new, cut) for a, (_, _, _, blank, cut, new) in zip(initials, rows, strict=True))
    known = [t for t, *_ in rows if t is not None]
    found = [search(marks)] if whole else [search(marks, a, (b,), False) for a, b in PAIRS]
    audits = [f[1] if f else None for f in found]
    order = sorted(range(len(found)), key=lambda k: (audits[k] is None, audits[k] or ""))
    return {
        "conv_id": conv, "part": part, "seq": seq, "open": not whole, "marks": marks,
        "turns": [t for t, *_ in rows], "roles": [r[1] for r in rows], "keys": [r[2] for r in rows],
        "costs": [f[0] if f else None for f in found], "audits": audits, "ranks": [order.index(k) for k in range(len(order))],
        "n": len(rows), "blank": sum(r[3] for r in rows), "duplicate": sum(not r[3] and not r[5] for r in rows), "truncated": sum(m.isupper() for m in marks),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "head": initials[0], "tail": initials[-1], "low": min(known, default=None), "high": max(known, default=None), "n_turns": len(set(known)),
    }


def stretches(found: DataFrame) -> DataFrame:
    """The faults' rows in order, as stretches with their cheapest edits; written, as several results are made from them."""
    small_batches(found.sparkSession)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]
    names = ("conv_id", "turn", "role", "key", "n", "blank", "cut", "new")
    schema = STRETCHES.format(dict(found.dtypes)["conv_id"])
    ranged = found.select(*names).repartitionByRange(*order).sortWithinPartitions(*order)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        conv, seq, first, made = None, 0, True, []

        def close(end: bool) -> None:  # a conversation's stretch; the task's first and last conversation may go on elsewhere
            nonlocal seq
            made.append(_stretch(conv, part, seq, held, end and seq == 0 and not first))
            seq += 1
            held.clear()

        for b in batches:
            for conv_id, turn, role, key, n, blank, cut, new in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and conv_id != conv:
                    close(True)
                    first = False
                if conv_id != conv:
                    seq = 0
                conv = conv_id
                for k in range(n):
                    if len(held) == STRETCH:
                        close(False)
                    held.append((turn, role, key, blank, cut, new and k == 0))
            if len(made) >= 64:
                yield pa.RecordBatch.from_pylist(made, arrow)
                made.clear()
        if held:
            close(False)
        if made:
            yield pa.RecordBatch.from_pylist(made, arrow)

    return checkpointed(ranged.mapInArrow(cut, schema))


TOTALS = ("blank", "duplicate", "truncated")
LINKED = "conv_id {0}, part int, seq long, entry int, audit string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _linked(audits: pd.DataFrame) -> pd.DataFrame:
    """One conversation's stretches: the state at each one's start, the pair it takes, and, in the first row, the totals."""
    s = audits.sort_values(["part", "seq"]).reset_index(drop=True)
    rest = [[0, 2 * INSERT, INSERT, 0]]
    costs = [{p: c for p, c in zip(PAIRS, row, strict=True) if c is not None and c == c} for row in s["costs"]]
    for row in reversed(costs):
        rest.append([min((c + rest[-1][b] for (a, b), c in row.items() if a == entry), default=float("inf")) for entry in range(4)])
    rest.reverse()
    entry, chosen = START, []
    for k, row in enumerate(costs):
        best = [p for p, c in row.items() if p[0] == entry and c + rest[k + 1][p[1]] == rest[k][entry]]
        pair = min(best, key=lambda p: s["ranks"][k][PAIRS.index(p)])
        chosen.append(pair)
        entry = pair[1]
    known = s.dropna(subset=["low"])
    twice = int((known["low"].iloc[1:].to_numpy() == known["high"].iloc[:-1].to_numpy()).sum())
    gaps = int(known["high"].max() - known["low"].min()) + 1 - (int(known["n_turns"].sum()) - twice) if len(known) else 0
    across = sum(a + b not in ("su", "ua", "au") for a, b in zip(s["tail"].iloc[:-1], s["head"].iloc[1:], strict=True))
    out = s[["conv_id", "part", "seq"]].copy()
    out["entry"], out["audit"] = [p[0] for p in chosen], [str(PAIRS.index(p)) for p in chosen]
    totals = {"gaps": gaps, "illegal": int(s["illegal"].sum()) + across, "cost": int(rest[0][START])} | {c: int(s[c].sum()) for c in TOTALS}
    for name, value in totals.items():
        out[name] = [value] + [0] * (len(out) - 1)
    out.loc[len(out) - 1, "audit"] += "|" + TAILS[entry]
    return out[[c.split()[0] for c in LINKED.split(", ")]]


def edits(found: DataFrame) -> DataFrame:
    """Each stretch with its entry state and audit, and counts that add up over a conversation."""
    kind = dict(found.dtypes)["conv_id"]
    gaps = F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.col("high") - F.col("low") + 1 - F.col("n_turns"))
    one = found.where("not open").select("conv_id", "part", "seq", F.lit(START).alias("entry"), F.col("audits")[0].alias("audit"), gaps.cast("long").alias("gaps"), *TOTALS, "illegal", F.col("costs")[0].alias("cost"), "marks", "turns", "roles", "keys")
    several = found.where("open")
    numbers = several.select("conv_id", "part", "seq", "costs", "ranks", *TOTALS, "illegal", "head", "tail", "low", "high", "n_turns")
    linked = numbers.groupBy("conv_id").applyInPandas(_linked, LINKED.format(kind)).withColumnRenamed("conv_id", "c")
    pair = F.split("audit", r"\|")
    audit = F.concat(F.col("audits")[pair[0].cast("int")], F.coalesce(F.try_element_at(pair, F.lit(2)), F.lit("")))
    met = several.drop(*TOTALS, "illegal").join(linked, ["part", "seq"]).where(F.col("conv_id").eqNullSafe(F.col("c")))
    return one.unionByName(met.select("conv_id", "part", "seq", "entry", audit.alias("audit"), "gaps", *TOTALS, "illegal", "cost", "marks", "turns", "roles", "keys"))


def _kept(entry: int, audit: str, marks: str) -> Iterator[tuple[int | None, str, str | None]]:
    """(place of a message that stays or None for the end, roles inserted before it, its new role or None)."""
    state, at, before = entry, 0, ""
    for edit in audit:
        role, after = _next(state)
        if edit == "D":
            at += 1
        elif edit == "I":
            before, state = before + role, after
        else:
            system = edit == "K" and marks[at].lower() == "s"
            yield at, before, None if edit == "K" else NAMES[role]
            at, before, state = at + 1, "", SYSTEM if system else after
    if before:
        yield None, before, None


def decisions(found: DataFrame) -> DataFrame:
    """A row for each message that stays, with the roles inserted before it, and one for inserts at the end (``last``)."""
    kind = dict(found.dtypes)["conv_id"]
    schema = f"conv_id {kind}, last boolean, turn long, role string, key binary, before string, new_role string"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            for conv, entry, audit, marks, turns, roles, keys in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for at, before, role in _kept(entry, audit, marks):
                    row = (conv, at is None, *((None, "", b"") if at is None else (turns[at], roles[at], keys[at])), before, role)
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
            types = (b.schema.field(0).type, pa.bool_(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string())
            yield pa.record_batch({c: pa.array(v, t) for (c, v), t in zip(out.items(), types, strict=True)})

    return found.select("conv_id", "entry", "audit", "marks", "turns", "roles", "keys").mapInArrow(each, schema)


def _ordered(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Messages, each behind the decision on it, by conversation and in order."""
    texts = rows.select("conv_id", F.lit(False).alias("last"), F.col("turn").cast("long").alias("turn"), "role", _key().alias("key"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("new_role"), "text")
    both = texts.unionByName(decisions(found).withColumn("text", F.lit(None).cast("string")))
    order = (F.col("conv_id").asc_nulls_first(), "last", F.col("turn").asc_nulls_first(), "role", "key", F.col("text").asc_nulls_first())
    return both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "last", "key", "role", "before", "new_role", "text")


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str, str]]:
    """(conversation, role, text, edit) of each message of the repaired conversations, in order."""
    waiting = None
    for b in batches:
        for conv, last, key, role, before, new_role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if before is not None:
                yield from ((conv, NAMES[r], "", "I") for r in before)
                waiting = None if last else (key, new_role)
            elif waiting is not None and waiting[0] == key:
                yield conv, waiting[1] or role, text, "R" if waiting[1] else "K"
                waiting = None


def _typed(batches: Iterator[pa.RecordBatch], seen: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The batches; ``seen`` gets the type of their first column."""
    for b in batches:
        seen[:] = [b.schema.field(0).type]
        yield b


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations' messages: conv_id, place (from 0), role, text, edit (K, R or I)."""
    ordered = _ordered(rows, edits(stretches(faults(rows))))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list[pa.DataType] = []
        held, conv, place = [], None, -1

        def batch() -> pa.RecordBatch:
            convs, places, *others = zip(*held, strict=True)
            held.clear()
            return pa.record_batch({"conv_id": pa.array(convs, kind[0]), "place": pa.array(places, pa.int64()), **{n: pa.array(v, pa.string()) for n, v in zip(("role", "text", "edit"), others, strict=True)}})

        for c, *message in _messages(_typed(batches, kind)):
            conv, place = c, place + 1 if c == conv and place >= 0 else 0
            held.append((c, place, *message))
            if len(held) == 256:
                yield batch()
        if held:
            yield batch()

    return ordered.mapInArrow(each, f"conv_id {dict(rows.dtypes)['conv_id']}, place long, role string, text string, edit string")


def _digests(ordered: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` lines, fed message by message."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list[pa.DataType] = []
        done, conv, state = [], None, None

        def batch() -> pa.RecordBatch:
            convs, hashes = zip(*done, strict=True)
            done.clear()
            return pa.record_batch({"conv_id": pa.array(convs, kind[0]), "repaired_sha256": pa.array(hashes)})

        for c, role, text, _ in _messages(_typed(batches, kind)):
            if state is not None and c == conv:
                state.update(b"\n")
            else:
                if state is not None:
                    done.append((conv, state.hexdigest()))
                state, conv = hashlib.sha256(), c
            state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if len(done) == 4096:
                yield batch()
        if state is not None:
            done.append((conv, state.hexdigest()))
        if done:
            yield batch()

    return ordered.mapInArrow(each, f"conv_id {dict(ordered.dtypes)['conv_id']}, repaired_sha256 string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(originals: DataFrame, rows: DataFrame) -> DataFrame:
    """For each conversation of ``originals``: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of its messages in ``rows``."""
    found = edits(stretches(faults(rows)))
    digests = _digests(_ordered(rows, found))
    of = F.array_sort(F.collect_list(F.struct("part", "seq", "audit")))
    counted = found.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in COUNTS), F.array_join(F.transform(of, lambda s: s["audit"]), "").alias("audit"))
    together = columns(originals, "conv_id").distinct().unionByName(counted, allowMissingColumns=True).unionByName(digests, allowMissingColumns=True)
    empty = hashlib.sha256().hexdigest()
    return together.groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in COUNTS), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256")
    )
