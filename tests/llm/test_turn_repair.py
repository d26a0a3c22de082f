"""Conversation repair: the whole query against a plain version that tries all edits, long and odd conversations."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest

from motionlake.llm import queries as Q
from motionlake.llm import turn_repair as R
from motionlake.llm.common import table

SF = "/root/testdata/sf0.001"
DDL = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain_damage(rows):
    told = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = "user" if d == 4 else told(role), told(text)
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        yield from [(conv, turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)


def plain_edits(turns):
    """Cost, audit and (role, text) by settling every prefix of the turns and every role sequence's state by relaxation."""
    pattern = {"": "su", "s": "u", "u": "a", "a": "u"}  # what may follow the last role
    best = {"": (0, "", [])}

    def take(into, state, found):
        if state not in into or found[:2] < into[state][:2]:
            into[state] = found

    def inserts(layer):
        for _ in range(4):
            for state, (cost, audit, said) in list(layer.items()):
                for to in set(pattern[state]) & {"u", "a"}:
                    take(layer, to, (cost + 2, audit + "I", [*said, ({"u": "user", "a": "assistant"}[to], "")]))
        return layer

    best = inserts(best)
    for role, text, fault in turns:
        layer = {}
        for state, (cost, audit, said) in best.items():
            take(layer, state, (cost + 3, audit + "D", said))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] and role[0] in pattern[state]:
                    take(layer, role[0], (cost + more, audit + "K", [*said, (role, text)]))
                for new in ("user", "assistant"):
                    if new[0] in pattern[state]:
                        take(layer, new[0], (cost + 2 + more, audit + "R", [*said, (new, text)]))
        best = inserts(layer)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def plain(rows):
    rows = list(rows)
    by = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in plain_damage(rows):
        by[conv].append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).digest(), text))
    out = []
    for conv, turns in by.items():
        turns.sort()
        seen, told = set(), []
        for *_, role, _, text in turns:
            words = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            told.append((role, text, fault))
        numbers = {t[1] for t in turns if t[0]}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        initials = [role[:1] for role, _, _ in told]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, said = plain_edits(told)
        faults = [sum(f == x for _, _, f in told) for x in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_equals_plain_version(spark, sf):
    df = Q.queries()["op13_turn_repair"](spark, sf)
    assert df.columns == COLUMNS
    rows = sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows == plain(tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect())


def odd_rows(n, seed):
    draw = random.Random(seed)
    pick = lambda *x: draw.choice(x)
    return [
        (pick(None, *range(60)), pick(None, *range(-3, 9)), pick("user", "assistant", "system", "tool", "", None, "user", "assistant"), pick("Yes.", "no", "Why? ", "", None, " ", "So!\n", "text\t", f"{draw.random()}.", "a" * 3_000))
        for _ in range(n)
    ]


def test_odd_rows_equal_plain_version(spark):
    rows = odd_rows(900, 11)
    df = Q.turn_repair_of(spark.createDataFrame([(*r, "x", 1) for r in rows], f"{DDL}, audit string, times int"))
    assert sorted((tuple(r) for r in df.collect()), key=repr) == plain(rows)


def test_search_takes_the_least_audit():
    draw = random.Random(7)
    kinds = {"x": "blank", "o": "", "O": "truncated"}
    for _ in range(3_000):
        turns = "".join(draw.choice("suaSUAoOx") for _ in range(draw.randrange(12)))
        plainly = plain_edits([(t.lower(), "", kinds.get(t, "truncated" if t.isupper() else "")) for t in turns])
        assert R.search(turns) == plainly[:2], turns


def test_audits_compare_like_texts():
    draw, root = random.Random(2), R.Audit()
    texts = ["".join(draw.choice("DIKR"[: 1 + k % 4]) for _ in range(draw.randrange(40))) for k in range(400)]

    def node(text):
        at = root
        for c in text:
            at = at.then(c)
        return at

    nodes = [node(t) for t in texts]
    assert all((a < b) == (s < t) and (a is b) == (s == t) for a, s in zip(nodes, texts) for b, t in zip(nodes, texts)) and str(nodes[5]) == texts[5]


def test_long_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2 if t % 50 else 1], f"turn {t}.") for t in range(30_000)]
    got = Q.turn_repair_of(spark.createDataFrame(rows, DDL)).collect()
    assert len(got) == 1 and len(got[0].audit) > 25_000
    short = [r for r in rows if r[1] < 3_000]
    assert [tuple(r) for r in Q.turn_repair_of(spark.createDataFrame(short, DDL)).collect()] == plain(short)


def test_repaired_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(5, 0, "assistant", "Hello.", 1), (5, 1, "assistant", "And more.", 2), (6, 1, "user", " ", 1), (7, 0, "user", "Gone.", 0), (8, None, "user", "Hi.", 1)], f"{DDL}, times int")
    plans = R.plans(rows)
    told = {r.conv_id: (r.cost, r.audit, r.duplicate, r.illegal) for r in plans.collect()}
    assert told == {5: (5, "RKD", 1, 2), 6: (3, "D", 0, 0), 7: (0, "", 0, 0), 8: (2, "KI", 0, 0)}
    out = [tuple(r) for r in R.repaired(rows, plans).orderBy("conv_id", "place").collect()]
    assert out == [(5, 0, 0, "user", "Hello.", "R"), (5, 1, 1, "assistant", "And more.", "K"), (8, 0, None, "user", "Hi.", "K"), (8, 1, None, "assistant", "", "I")]
    empty = spark.createDataFrame([], DDL)
    assert Q.turn_repair_of(empty).count() == 0 and R.repaired(R.damaged(empty), R.plans(R.damaged(empty))).count() == 0
