from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casepulse.llm.packing import BestFit, pack, packers_for


def plain_best_fit(lengths, capacity, open_bins):
    """Sequence sizes by a search over all open bins."""
    bins, used, out = {}, [], []
    for length in lengths:
        fits = {n: left for n, left in bins.items() if left >= length}
        if not fits:
            if len(bins) == open_bins:
                least = min(bins.values())
                bins.pop(max(n for n, left in bins.items() if left == least))
            fits = {len(used): capacity}
            used.append(0)
        tightest = min(fits.values())
        out.append(tightest)
        number = max(n for n, left in fits.items() if left == tightest)
        used[number] += length
        bins[number] = tightest - length
        if not bins[number]:
            bins.pop(number)
    return out, len(used)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 8))
def test_best_fit_takes_the_tightest_open_bin(lengths, open_bins):
    fitter = BestFit(20, open_bins)
    placed = fitter.put_all(lengths)
    want, made = plain_best_fit(lengths, 20, open_bins)
    assert [20 - offset for _, offset in placed] == want
    assert fitter.made == made and fitter.open <= open_bins


def test_no_sequence_overflows_or_has_a_gap(llm):
    rng = random.Random(4)
    rows = [(k % 900, k // 900, rng.randint(1, 100), "x") for k in range(3000)]
    pieces = llm.createDataFrame(rows, "doc_id long, piece int, length long, sequence_id string").withColumn("task", F.lit(1))
    packed = pack(pieces, packers=3, capacity=100)
    assert packed.columns == ["doc_id", "piece", "length", "task", "sequence_id", "offset"]
    found = {}
    for r in packed.collect():
        found.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in found.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 100
    assert sum(map(len, found.values())) == 3000
    assert len(found) <= 1.02 * sum(r[2] for r in rows) / 100 + 3
    assert {tuple(r) for r in packed.collect()} == {tuple(r) for r in pack(pieces.repartition(7), packers=3, capacity=100).collect()}


def test_empty_table_ties_and_wrong_lengths(llm):
    schema = "doc_id long, piece int, length long"
    assert pack(llm.createDataFrame([], schema), packers=2).count() == 0
    assert packers_for(llm.createDataFrame([], schema)) == 1 and packers_for(llm.range(100), 30) == 4
    same = llm.createDataFrame([(None, 0, 512)] * 4, schema)
    assert sorted((r.offset) for r in pack(same, packers=2).collect()) == [0, 0, 512, 512]
    with pytest.raises(Exception, match="lengths must be"):
        pack(llm.createDataFrame([(1, 0, 2000)], schema), packers=1).collect()


def test_few_long_texts_are_dealt_to_several_packers(llm):
    docs = llm.range(8).selectExpr("id as doc_id", "repeat('word ', 30000) as text")
    assert packers_for(docs, 40) == 1 and packers_for(docs, 40, capacity=1024, text_col="text") == 10
    assert packers_for(docs.where("doc_id < 0"), 40, text_col="text") == 1
