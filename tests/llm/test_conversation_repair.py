from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from panelcast.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def cheapest(initials, marks):
    """From the end: costs to go, then the least letter that keeps them."""
    n = len(initials)
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}

    def steps(i, state):
        yield "I", 3, i, nxt[state]
        if i < n:
            yield "D", 4, i + 1, state
            if marks[i] not in "bd":
                more = 3 * (marks[i] == "t")
                yield "R", 3 + more, i + 1, nxt[state]
                if initials[i] in {"": "su", "s": "u", "u": "a", "a": "u"}[state]:
                    yield "K", more, i + 1, initials[i]

    @cache
    def to_go(i, state, inserts=0):
        if i == n and state in ("", "a"):
            return 0
        return min((c + to_go(j, s, inserts + 1 if j == i else 0) for e, c, j, s in steps(i, state) if not (e == "I" and inserts == 3)), default=10**9)

    for i in range(n, -1, -1):
        for state in nxt:
            to_go(i, state)
    i, state, audit, cost = 0, "", "", 0
    while not (i == n and state in ("", "a")):
        best = to_go(i, state)
        letter, c, j, s = min((x for x in steps(i, state) if x[1] + to_go(x[2], x[3]) == best), key=lambda x: x[0])
        i, state, audit, cost = j, s, audit + letter, cost + c
    return cost, audit


def every_edit_list(initials, marks, most):
    """(cost, audit) of all edit lists up to a cost, by trying them all."""
    out = []

    def go(i, made, cost, audit):
        if cost > most:
            return
        if i == len(initials) and re.fullmatch("(s?(ua)+)?", made):
            out.append((cost, audit))
        for r in "ua":
            go(i, made + r, cost + 3, audit + "I")
        if i < len(initials):
            go(i + 1, made, cost + 4, audit + "D")
            if marks[i] not in "bd":
                more = 3 * (marks[i] == "t")
                go(i + 1, made + initials[i], cost + more, audit + "K")
                for r in "ua":
                    go(i + 1, made + r, cost + 3 + more, audit + "R")

    go(0, "", 0, "")
    return out


def repaired(rows, audit):
    out, i, state = [], 0, ""
    nxt = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    for letter in audit:
        role, text = nxt[state], ""
        if letter != "I":
            role, text = (rows[i][2] if letter == "K" else role), rows[i][3]
            i += 1
        if letter != "D":
            out.append(f"{role}:{text}")
            state = role[0]
    return "\n".join(out)


def brute_force(table):
    out = []
    key = lambda x: (x is not None, x or 0)
    for conv in {r[0] for r in table}:
        rows = sorted(damage([r for r in table if r[0] == conv]), key=lambda r: key(r[1]))
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        marks = faults(rows)
        firsts = [r[2][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False))
        cost, audit = cheapest(["-" if f not in ("s", "u", "a") else f for f in firsts], marks)
        out.append((conv, gaps, *(marks.count(m) for m in "bdt"), illegal, cost, audit, hashlib.sha256(repaired(rows, audit).encode()).hexdigest()))
    return sorted(out, key=str)


def test_agenda_equals_all_edit_lists():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(0, 4)
        initials = "".join(rng.choice("suua-") for _ in range(n))
        marks = "".join(rng.choice("---tbd") for _ in range(n))
        want = cheapest(initials, marks)
        assert min(every_edit_list(initials, marks, want[0])) == want
        [(state, got)] = C.lightest(initials, marks, C.NONE, True).items()
        assert got == want and state in C.GOALS


def test_chained_spans_equal_the_whole():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 30)
        initials = "".join(rng.choice("suaua-") for _ in range(n))
        marks = "".join(rng.choice("-----tbd") for _ in range(n))
        cuts = sorted({0, n, *(rng.randrange(0, n + 1) for _ in range(rng.randrange(0, 6)))})
        costs, ranks, audits = [], [], []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            cost, rank, audit = [None] * 16, [None] * 16, [None] * 16
            for s in range(4):
                spans = C.lightest(initials[lo:hi], marks[lo:hi], s, False)
                for k, t in enumerate(sorted(spans, key=lambda t: spans[t][1])):
                    (cost[4 * s + t], audit[4 * s + t]), rank[4 * s + t] = spans[t], k
            costs.append(cost)
            ranks.append(rank)
            audits.append(audit)
        cost, spans, closing = C.chain(costs, ranks)
        assert (cost, "".join(a[x] for a, x in zip(audits, spans, strict=True)) + closing) == cheapest(initials, marks)


@pytest.fixture(scope="module")
def table():
    rng = random.Random(5)
    rows = []
    for conv in range(60):
        roles = ["system"] * (rng.random() < 0.3) + [("user", "assistant")[i % 2] for i in range(rng.randrange(1, 9))]
        for turn, role in enumerate(roles):
            role = rng.choice([role] * 9 + ["tool", "", None, "system"])
            text = rng.choice([f"Line {rng.randrange(6)}.", f"Line {rng.randrange(99)}!", "cut off", "What?\n", " \t", "", None, "a.\x85"])
            rows.append((conv, turn, role, text))
    rows += [(100, None, "user", "One."), (100, 3, "assistant", "Two."), (100, 9, "user", "Three.")]
    rows += [(None, t, ("user", "assistant")[t % 2], f"Row {t % 7}.") for t in range(40)]
    rows += [(101, t, ("user", "assistant")[t % 2], f"Long talk {t}.") for t in range(300)]
    return rows


@pytest.mark.parametrize("chunk", [4, 1024])
def test_query_equals_brute_force(spark, table, chunk):
    got = C.damage_and_repair(spark.createDataFrame(table, SCHEMA).selectExpr("*", "1 AS row", "'x' AS place", "'x' AS edit", "'x' AS kind"), chunk)
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(table)


def test_conversations_without_rows_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = C.damage_and_repair(spark.createDataFrame([(gone, 0, "user", "Hello.")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    empty = spark.createDataFrame([], SCHEMA)
    assert C.damage_and_repair(empty).count() == 0
    assert C.repair(empty).messages.count() == 0


def test_messages_in_order_and_ties_of_one_turn(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "user", "And"), (1, 3, "assistant", None)]
    found = C.repair(spark.createDataFrame(rows, SCHEMA))
    s = found.summary.first()
    assert (s.blank, s.duplicate, s.truncated, s.illegal, s.cost, s.audit) == (1, 1, 1, 1, 4 + 4 + 4, "KDKDD")
    assert [(r.edit, r.role, r.text) for r in found.messages.orderBy("place").collect()] == [("K", "user", "Hi."), ("K", "assistant", "Yes.")]
