import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from sigloom.llm import conversations
from sigloom.llm.conversations import CUT, END, GONE, OK, START, cheapest
from sigloom.llm.queries import QUERIES


def plain(turns):
    """(cost, audit) by trying every edit of every turn, and insertions before and after each."""

    @cache
    def rest(i, state):
        """All that can follow, cheapest first, of those of a cost the ASCII-least."""
        found = []
        if i == len(turns) and state in (0, 3):
            found.append((0, ""))
        moves = {0: 2, 1: 2, 2: 3, 3: 2}
        here = [(state, 0, "")]
        for _ in range(3):
            s, cost, edits = here[-1]
            here.append((moves[s], cost + 5, edits + "I"))
        for s, cost, edits in here:
            if i == len(turns):
                if s in (0, 3):
                    found.append((cost, edits))
                continue
            role, fault = turns[i]
            ways = [(s, 2, "D")]
            if fault != GONE:
                more = 5 * (fault == CUT)
                ways += [(1, more, "K")] if s == 0 and role == "s" else []
                ways += [(2, more, "K")] if s != 2 and role == "u" else []
                ways += [(3, more, "K")] if s == 2 and role == "a" else []
                ways.append((moves[s], 1 + more, "R"))
            for to, more, edit in ways:
                after = rest(i + 1, to)
                if after:
                    found.append((cost + more + after[0], edits + edit + after[1]))
        return min(found, default=None)

    return rest(0, 0)


def test_search_equals_plain_recursion():
    kinds = [(r, f) for r in ("s", "u", "a", "t", "") for f in (OK, GONE, CUT)]
    for n in range(4):
        for turns in itertools.product(kinds, repeat=n):
            assert cheapest(list(turns), START, END) == plain(turns)
    r = random.Random(0)
    for n in (5, 8, 20, 64):
        for _ in range(60):
            turns = tuple((r.choice("ssuuuaaat"), r.choice([OK, OK, OK, GONE, CUT])) for _ in range(n))
            assert cheapest(list(turns), START, END) == plain(turns)
    for role, fault in itertools.product("suat", (OK, GONE, CUT)):
        assert cheapest([(role, fault)] * 64, START, END) == plain(((role, fault),) * 64)


def expected(rows):
    """Per conversation, with the plain search."""
    space = lambda x: " " if x is None else x
    groups: dict = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text, held = space(role), space(text), groups.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, held in groups.items():
        held.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()))
        seen, turns, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in held:
            visible = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            turns.append((role[:1], OK if fault is None else CUT if fault == "truncated" else GONE))
        cost, audit = plain(tuple(turns))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        numbers = [t for t, _, _ in held if t is not None]
        lines, i, state = [], iter(held), "a"
        for k, e in enumerate(x for x in audit):
            row = None if e == "I" else next(i)
            if e == "D":
                continue
            state = "s" if e == "K" and row[1][:1] == "s" else "u" if state in "sa" else "a"
            name = {"u": "user", "a": "assistant"}.get(state)
            lines.append(f"{row[1] if e == 'K' else name}:{'' if e == 'I' else row[2]}")
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


KIND = "conv_id long, turn long, role string, text string"


def made(seed, n):
    r = random.Random(seed)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["yes.", "no!", "cut", "", " \t", None, "a. ", "ok?\n", "é。"]
    rows = [(r.choice([0, 1, 2, 3, None]), r.choice([*range(30), None, 10**6]), r.choice(roles), r.choice(texts) if r.random() < 0.4 else f"text {r.random()}.") for _ in range(n)]
    long_one = [(7, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(600)]
    return rows + long_one + [(8, 0, "user", "x" * 300_000 + ".")] + rows[:5]


@pytest.mark.parametrize(("seed", "parts"), [(0, 1), (1, 5)])
def test_equals_plain_version(spark, tmp_path, seed, parts):
    """Conversations of hundreds of turns over several partitions and blocks, nulls, ties, empty and long texts."""
    rows = made(seed, 400)
    spark.createDataFrame(rows, KIND).withColumns({n: F.lit(1) for n in ("c", "row", "cost", "fault", "kind")}).repartition(parts).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(QUERIES["op11_conversation_repair"](spark, str(tmp_path))) == expected(rows)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op11_conversation_repair"](spark, str(tmp_path)).count() == 0


def test_repaired_turns_alternate(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "There?"), (1, 2, "assistant", "Yes."), (1, 3, "user", "So"), (1, 4, "assistant", "Go.")], "conv long, turn long, role string, text string")
    summary, repaired = conversations.repair(turns)
    assert summary.select("cost", "audit", "illegal", "truncated").first() == (4, "KRRDK", 1, 1)
    assert [r["role"] for r in repaired.orderBy("part", "block", "seq").collect()] == ["user", "assistant"] * (repaired.count() // 2)
