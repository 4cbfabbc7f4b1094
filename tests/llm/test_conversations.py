"""Conversation repair against a plain shortest path over whole conversations, one task or many."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from shiftframe.llm import conversations
from shiftframe.llm.queries import op13_conversation_repair

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, costs int, part string"
STOPS, WHITE = ".!?", " \t\n\x0b\f\r"


def said(x):
    return " " if x is None else str(x)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def plain_order(row):
    _, turn, role, text = row
    return turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain(rows):
    """conv_id -> the contract's columns, by a uniform-cost search whose queue is ordered by cost and audit."""
    found = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for conv, *_ in rows}
    by = {}
    for row in plain_damage(rows):
        by.setdefault(row[0], []).append(row)
    for conv, turns in by.items():
        turns.sort(key=plain_order)
        seen, faults = set(), []
        for _, _, role, text in turns:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare.strip(WHITE) else "duplicate" if (role, text) in seen else "" if bare[-1] in STOPS else "truncated")
            seen.add((role, text))
        known = {t for _, t, _, _ in turns if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        queue, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, last, made = heapq.heappop(queue)
            if (i, last) in done:
                continue
            done.add((i, last))
            if i == len(turns) and last in ("", "a"):
                break
            wanted = "a" if last == "u" else "u"
            name = {"a": "assistant", "u": "user"}[wanted]
            heapq.heappush(queue, (cost + 3, audit + "I", i, wanted, (*made, f"{name}:")))
            if i == len(turns):
                continue
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, last, made))
            _, _, role, text = turns[i]
            if faults[i] in ("blank", "duplicate"):
                continue
            more = 3 * (faults[i] == "truncated")
            if role[:1] == wanted or (role[:1] == "s" and last == ""):
                heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[:1], (*made, f"{role}:{text}")))
            heapq.heappush(queue, (cost + more + 3, audit + "R", i + 1, wanted, (*made, f"{name}:{text}")))
        found[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return found


def same(turns, rows):
    found = {r[0]: tuple(r)[1:] for r in conversations.audits(turns, conversations.damaged(turns)).collect()}
    assert found == plain(rows)


def test_the_query_equals_a_plain_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r[0]: tuple(r)[1:] for r in op13_conversation_repair(spark, DATA).collect()}
    assert found == plain(rows)


@pytest.mark.parametrize("length", [3, 96, 97, 700])
def test_long_conversations_in_stretches(spark, length):
    random.seed(length)
    role = lambda k: random.choice(["user", "assistant", "system", "tool", "user" if k % 2 == 0 else "assistant", "user" if k % 2 == 0 else "assistant"])
    rows = [(c, k, role(k), random.choice(["One.", "Two", "", "Three!", f"Words {k}.", f"Words {k}", " \n"])) for c in (1, 2) for k in range(length)]
    turns = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA).repartition(5)
    same(turns, rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hello."), (1, None, "user", "A."), (1, None, "assistant", "B."), (1, 5, "", "No initial."), (1, 9, "assistant", "C.")]
    rows += [(2, k, "user", "") for k in range(4)] + [(3, 2, "user", "Same."), (3, 2, "user", "Same."), (3, 2, "user", "Same.")]
    rows += [(4, 0, "system", "x" * 200_000 + "!"), (4, 1, "user", "²³é" * 9), (5, 7, "usher", "Kept as it is?"), (5, 8, "ass", "Kept too.\n")]
    turns = spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA).repartition(3)
    same(turns, rows)
    messages = conversations.repaired(conversations.damaged(turns)).collect()
    assert {m.edit for m in messages} <= {"K", "R", "I"}
    for conv in {m.conv_id for m in messages}:
        own = sorted((m for m in messages if m.conv_id == conv), key=lambda m: m.place)
        assert [m.place for m in own] == list(range(len(own))) and re.fullmatch("(s?(ua)+)?", "".join(m.role[0] for m in own))


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.audits(none, conversations.damaged(none)).count() == 0


def test_search_finds_the_least_audit():
    random.seed(5)
    for _ in range(3000):
        marks = "".join(random.choice("uauauaUA-sSxX") for _ in range(random.randint(0, 8)))
        entry, goals, inserts = random.choice([(0, (0, 3), True), (2, (3,), False), (0, (2,), False), (1, (1,), False), (3, (2,), False)])
        queue, done, want = [(0, "", 0, entry)], set(), None
        while queue:
            cost, audit, i, state = heapq.heappop(queue)
            if (i, state) in done:
                continue
            done.add((i, state))
            if i == len(marks) and state in goals:
                want = cost, audit
                break
            for edit, more, j, after in conversations._moves(marks, i, state, inserts):
                heapq.heappush(queue, (cost + more, audit + edit, j, after))
        if marks:
            assert conversations.search(marks, entry, goals, inserts) == want
