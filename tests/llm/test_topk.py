"""Exact search against scoring every pair in Python."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casepulse.llm import topk

CLASHING = ("row", "v", "norm", "low", "bin", "rank", "score", "i", "query", "asks")


def brute(rows, k=20, every=20):
    whole = []
    for n, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((n, i, [max(-topk.LARGEST, min(topk.LARGEST, math.floor(64 * x))) for x in v]))
    out = []
    for n, i, v in whole:
        if i is not None and i % every == 0:
            found = sorted(
                (-max(-topk.MOST, min(topk.MOST, sum(a * b for a, b in zip(v, w, strict=False)))), j is None, j or 0, m, j)
                for m, j, w in whole if m != n
            )
            out += [(i, rank + 1, x[4], -x[0]) for rank, x in enumerate(found[:k])]
    return ordered(out)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v) for v in r))


def frame(llm, rows):
    df = llm.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    return df.withColumns({name: F.lit("x") for name in CLASHING})


def found(df, **options):
    return ordered(topk.top_k(df, F.col("vec_id") % 20 == 0, **options).collect())


ODD = [
    (0, [1.0, -0.5]), (1, None), (2, [None, 1.0]), (3, [math.inf, 0.0]), (4, [math.nan]), (None, [3.0, 1.0]), (None, [3.0, 1.0]),
    (20, []), (20, [1.0]), (0, [1.0, -0.5]), (7, [1e30, 1e30, 1.0]), (40, [1e30, -1e30]), (5, [-0.01, 0.001]),
]


@pytest.mark.parametrize("rows", [ODD, [], [(0, [1.0])], [(0, [1.0]), (1, [2.0])], [(1, [1.0])], [(0, None)] * 3])
def test_odd_rows(llm, rows):
    assert found(frame(llm, rows)) == brute(rows)


def test_a_third_are_copies_of_one_vector(llm):
    rows = [(i, [1.0, 2.0]) for i in range(200)] + [(1000 + i, [float(i % 7), -float(i % 5)]) for i in range(400)]
    assert found(frame(llm, rows)) == brute(rows)


def test_wide_scores_take_several_rounds(llm):
    made = np.random.default_rng(1).normal(0, 1e4, (300, 6)).astype("float32")
    rows = [(i, v.tolist()) for i, v in enumerate(made)]
    assert found(frame(llm, rows), k=3) == brute(rows, k=3)


def test_many_cells_agree_with_few(llm, testdata, monkeypatch):
    df = llm.read.parquet(f"{testdata}/embeddings.parquet")
    few = found(df)
    monkeypatch.setattr(topk, "CELL", 2)
    assert found(df) == few == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_counts_are_cut_below_the_own_kth_score_only():
    def side(vectors, **more):
        return pa.table({"row": list(range(len(vectors))), "v": [np.array(v, "int8").tobytes() for v in vectors], "width": pa.array([1] * len(vectors), pa.int32()), **more})

    queries = side([[1]], low=[-200], high=[200]).set_column(0, "row", pa.array([99]))
    got = topk.counted(queries, side([[5], [5], [9], [1], [-3]]), k=3, shift=1).to_pylist()
    assert got == [{"row": 99, "bin": 102, "n": 2}, {"row": 99, "bin": 104, "n": 1}]
