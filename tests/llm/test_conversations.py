"""Repaired conversations against an exhaustive search, with conversations divided among tasks."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tillflow.llm.conversation_digest import damage, digests
from tillflow.llm.conversation_repair import NEXT, Search, Steps, repair_conversations, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, copies int, place string"
SOLID = re.compile(r"[^\x20\x09-\x0D]")
EMPTY = hashlib.sha256(b"").hexdigest()


def faults_of(rows):
    """(initial, must go, truncated) and the fault counts of one conversation's ordered (turn, role, text)."""
    seen, kinds, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        solid = SOLID.findall(text)
        blank, again = not solid, (role, text) in seen
        cut = bool(solid) and solid[-1] not in ".!?"
        seen.add((role, text))
        fault = 0 if blank else 1 if again else 2 if cut else None
        if fault is not None:
            counts[fault] += 1
        kinds.append((role[:1], blank or again, cut and not again))
    return kinds, counts


def cheapest(kinds):
    """(cost, audit) of the cheapest repair by uniform-cost search over whole edit strings."""
    heap, best = [(0, "", 0, 0)], {}
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(kinds) and state in (0, 3):
            return cost, audit
        if best.get((at, state), (cost + 1,)) <= (cost, audit):
            continue
        best[at, state] = (cost, audit)
        for role, to in NEXT[state].items():
            if role != "s":
                heapq.heappush(heap, (cost + 3, audit + "I", at, to))
        if at < len(kinds):
            initial, must_go, cut = kinds[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state))
            for role, to in NEXT[state].items() if not must_go else ():
                stay = 3 if cut else 0
                if role == initial:
                    heapq.heappush(heap, (cost + stay, audit + "K", at + 1, to))
                if role != "s":
                    heapq.heappush(heap, (cost + 3 + stay, audit + "R", at + 1, to))
    raise AssertionError


def repaired(rows, audit):
    lines, at, opened = [], 0, 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at][1:]
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "K" and not lines and role[:1] == "s":
            opened = 1
        forced = "user" if (len(lines) - opened) % 2 == 0 else "assistant"
        lines.append(f"{role if edit == 'K' else forced}:{text}")
    return "\n".join(lines)


def expected(rows):
    """The digest of every conversation of (conv, turn, role, text, copies)."""
    groups: dict = {}
    for conv, turn, role, text, copies in rows:
        turns = groups.setdefault(conv, [])
        turns += [(turn, " " if role is None else role, " " if text is None else text)] * copies
    out = []
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        kinds, counts = faults_of(turns)
        cost, audit = cheapest(kinds)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        text = repaired(turns, audit)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), text))
    return sorted(out, key=repr)


def conversations(seed):
    rnd = random.Random(seed)
    rows = []
    for conv in [None, *range(30)]:
        size = rnd.choice([1, 2, 3, 5, 9]) if conv != 7 else 400
        for turn in range(size):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
            text = rnd.choice(["Yes.", "no", " \n", "", None, "Why? \t", f"line {rnd.random()}.", f"cut {rnd.random()}", "Ünïcode!"])
            number = None if rnd.random() < 0.1 else turn * rnd.choice([1, 1, 1, 2])
            rows.append((conv, number, role, text, rnd.choice([0, 1, 1, 1, 1, 2])))
    rows += [(100, n, "user" if n % 2 == 0 else "assistant", "Good.", 1) for n in range(4)]
    rows += [(101, 0, "user", "Hi.", 0), (102, None, "system", "Only rules.", 1), (103, 0, "user", "x" * 200_000, 1)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,parts", [(1, 8), (2, 40), (3, 1)])
def test_repairs_against_exhaustive_search(spark, seed, parts):
    rows = conversations(seed)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
        edited, empty = repair_conversations(df, copies="copies")
        edited = edited.cache()
        found = sorted(((None if r[0] is None else int(r[0]), *r[1:]) for r in digests(edited, empty).collect()), key=repr)
        want = expected(rows)
        assert found == [w[:-1] for w in want]
        texts: dict = {}
        for r in repaired_turns(edited).orderBy("conv", "place", "step").collect():
            texts.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
        assert {c: "\n".join(t) for c, t in texts.items()} == {None if w[0] is None else str(w[0]): w[-1] for w in want if w[-1]}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "A. B! C?") for c in [None, *range(20)] for t in [None, *range(6)]]
    found = damage(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, kind int"))
    for (c, t, *_), r in zip(rows, found.collect()):
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        assert (r.copies, r.role, r.text) == (
            {0: 0, 3: 2}.get(kind, 1), "user" if kind == 4 else "assistant", {1: "", 2: "A B C"}.get(kind, "A. B! C?"))


def test_empty_table(spark):
    assert digests(*repair_conversations(spark.createDataFrame([], SCHEMA))).collect() == []


def test_settled_edits_leave_memory():
    """Where turns are in order the tree holds a few turns, however long the conversation."""
    search, steps, settled, most = Search(), Steps(), 0, 0
    for n in range(3000):
        settled += len(search.add(steps("ua"[n % 2], n % 50 == 49, n % 7 == 0)))
        most = max(most, n + 1 - settled)
    assert most < 200
