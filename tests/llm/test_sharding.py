from __future__ import annotations

import random
import zlib
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casepulse.llm import sharding
from tests.llm.conftest import ODD


def best_capacity(sizes, shards):
    def enough(capacity):
        used, left = 1, capacity
        for size in sizes:
            if size > capacity:
                return False
            if size > left:
                used, left = used + 1, capacity
            left -= size
        return used <= shards

    return bisect_left(range(sum(sizes) + 1), True, key=enough)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 8), st.integers(2, 9))
def test_bounds_from_some_sums_hold_and_all_sums_decide(sizes, shards, step):
    sums = list(accumulate(sizes, initial=0))
    some = sharding.Sums([*sums[::step], sums[-1]])
    best = best_capacity(sizes, shards)
    low, high = max(max(sizes), -(-sums[-1] // shards)), sums[-1]
    assert some.least(low, high, shards, hopeful=True) <= best <= some.least(low, high, shards, hopeful=False)
    # Learning about a region closes it.
    for a, z in list(some.open):
        inside = sums[bisect_right(sums, a):bisect_right(sums, z)]
        some.learn(a, z, [(x, x, 1) for x in inside])
    assert some.least(low, high, shards, True) == best == some.least(low, high, shards, False)
    ends = some.ends(best, shards, False)
    assert ends[-1] == sums[-1] and max(b - a for a, b in zip([0, *ends], ends, strict=False)) == best


@pytest.mark.parametrize("steps", [2, 512])
def test_cuts_are_minimax(llm, monkeypatch, steps):
    """Few places at a time take more rounds to the same answer."""
    monkeypatch.setattr(sharding, "STEPS", steps)
    monkeypatch.setattr(sharding, "RANGE_BITS", 3)
    rng = random.Random(steps)
    groups = {rng.getrandbits(63) - (1 << 62): int(rng.paretovariate(1.2) * 10) for _ in range(800)}
    rows = llm.createDataFrame(list(groups.items()), "hash long, size long")
    cuts = sharding.cut_hashes(rows, 7)
    sizes = [0] * 7
    for hash_, size in groups.items():
        sizes[sum(hash_ > cut for cut in cuts)] += size
    assert max(sizes) == best_capacity([groups[h] for h in sorted(groups)], 7)


@pytest.mark.parametrize("rows", [ODD, [(k, f"text {k % 50}" * (k % 9 + 1)) for k in range(500)], []], ids=["odd", "many", "empty"])
def test_shards(texts, rows):
    got = sharding.shard_by_bytes(texts(rows), shards=4).collect()
    assert sorted((r.doc_id is not None, r.doc_id, r.size, r.text_crc32) for r in got) == sorted(
        (i is not None, i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    ) if all(i is not None for i, _ in rows) else len(got) == len(rows)
    by_shard, by_text = {}, {}
    for r in got:
        assert 0 <= r.shard < 4
        by_shard.setdefault(r.shard, []).append(r.slot)
        by_text.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    assert all(len(shards) == 1 for shards in by_text.values())


def test_fewer_groups_than_shards_and_one_hot_text(texts):
    rows = [(k, "same text") for k in range(300)] + [(1000, "other")]
    got = sharding.shard_by_bytes(texts(rows), shards=16).collect()
    assert len({r.shard for r in got}) == 2 and sorted(r.slot for r in got if r.size == 10) == list(range(300))
