"""The prefix trie against dictionaries of prefixes in Python."""

from __future__ import annotations

import math
import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from casepulse.llm import prefix_trie
from casepulse.llm.order import running

SCHEMA = "conv_id long, turn long, role string, text string"
CLASHING = ("conv", "i", "n", "d", "rep", "seg", "at", "tree", "block", "comp")


def brute(rows, rebuild=True):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [tuple(x[2:]) for x in sorted(turns)] for c, turns in own.items()}
    convs, members, children = {}, {}, {}
    for c, turns in own.items():
        kept = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        convs[c] = own.get(c - int(math.fmod(c, 5)), [])[:kept] + turns[kept:] if rebuild else turns
        for d in range(len(convs[c]) + 1):
            members.setdefault(tuple(convs[c][:d]), []).append(c)
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    leaves, saved, out = {}, {}, []
    for key in sorted(members, key=len, reverse=True):
        below = children.get(key, [])
        leaves[key] = sum(leaves[x] for x in below) or 1
        saved[key] = (len(members[key]) - 1) * (len(key[-1][1].encode()) if key else 0) + sum(saved[x] for x in below)
        ends = sorted(c for c in members[key] if len(convs[c]) == len(key))
        out.append((
            min(members[key]), len(key), min(members[key[:-1]]) if key else None, len(members[key]), len(below), leaves[key], saved[key],
            sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return ordered(out)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v) for v in r))


def trie(llm, rows, rebuild=True, **options):
    df = rows if not isinstance(rows, list) else llm.createDataFrame(rows, SCHEMA).withColumns({name: F.lit(1) for name in CLASHING})
    conv = F.col("conv")
    made = {"kept": F.crc32(conv.cast("string")) % 9, "base": conv - conv % 5, "longest": 8} if rebuild else {}
    return ordered(prefix_trie.prefix_trie(df, **made, **options).collect())


RANDOM = random.Random(3)
ODD = [
    (1, None, None, None), (1, 0, "u", "a"), (1, 0, "u", "a"), (2, 0, "u", "é" * 9), (None, 1, "u", "x"), (7, 3, "u", ""),
    (7, 2, "a", "b"), (-3, 0, "u", "a"), (-3, 1, "u", "z"), (0, 0, "u", "x" * 300_000),
]
CASES = [
    ODD,
    [(c, t, "u", f"t{t}" if t < 40 * c + RANDOM.randint(0, 3) else f"{c}-{t}") for c in range(60) for t in range(RANDOM.randint(1, 90))],
    [(c, t, RANDOM.choice("ua"), RANDOM.choice(["x", "yy", "zzz"])) for c in range(400) for t in range(RANDOM.randint(0, 12))],
    [(c, t, "u", f"same{t}") for c in range(150) for t in range(c % 75)],
]
#: All of them beside each other: odd turns, deep and bushy prefixes, and prefixes of one another.
MANY = [(c if c is None else c + 1000 * k, t, role, text) for k, rows in enumerate(CASES) for c, t, role, text in rows]


@pytest.mark.parametrize(("rows", "rebuild"), [(MANY, True), (MANY, False), ([], True), (ODD[3:4], True), (ODD[4:5], False)])
def test_against_dictionaries(llm, rows, rebuild):
    assert trie(llm, rows, rebuild, small=4) == brute(rows, rebuild)


def test_long_conversations_and_one_of_thousands(llm, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    rows = [(c, t, "u", f"l{t}") for c in range(2) for t in range(700)] + [(9 + c, 0, "u", "l") for c in range(900)]
    assert trie(llm, rows, False, small=8) == brute(rows, False)


def test_every_split_halves_the_weight(llm, monkeypatch):
    """So rounds are few even for a forest that is one path."""
    rounds, split = [], prefix_trie.split

    def counted(*arguments):
        rounds.append(1)
        return split(*arguments)

    monkeypatch.setattr(prefix_trie, "split", counted)
    rows = CASES[-1]
    assert trie(llm, rows, False, small=1) == brute(rows, False)
    assert 3 <= len(rounds) <= 13


def test_conversations(llm, testdata):
    df = llm.read.parquet(f"{testdata}/conversations.parquet")
    assert trie(llm, df, small=4) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_running_values_over_blocks(llm):
    rows = llm.createDataFrame([(k, d, 3 * d + k) for k in (1, 2) for d in range(50)], "k long, d long, v long")
    got = running(rows, ["k"], "d", {"upto": F.col("v"), "x_all": F.col("v")}, block=7).orderBy("k", "d").collect()
    for r in got:
        if r.d == 0:
            total = mixed = 0
        total, mixed = total + r.v, mixed ^ r.v
        assert (r.upto, r.x_all) == (total, mixed)
