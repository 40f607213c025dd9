"""Exact top-k search by inner products of whole numbers: distributed histogram selection.

A stated set of query rows meets all rows in cells: each side is dealt by hash into groups of at
most some thousand rows, and a cell scores one group of queries against one group of candidates in
one product of matrices. No score is stored. In each round every cell counts the scores of each
query by bins, Spark adds the counts, and the bin in which the k-th score lies is the next round's
range, a thousand times finer, until a bin is one score. A last pass returns what lies above that
score, and of those equal to it the smallest ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casepulse.llm.common import importable, map_arrow, parts_of
from casepulse.sources.writers import stage

#: Rows of a group of queries or candidates, about; queries scored at a time; bits of a round's bins.
CELL, TOGETHER, BIN_BITS = 8192, 256, 10
#: Bounds of a component and of a score; up to EXACT, sums of products are exact as doubles.
LARGEST, MOST, EXACT = 2**31 - 1, 2**62 - 1, 2**53


def packed(batches: Iterator[pa.RecordBatch], *, scale: float) -> Iterator[pa.RecordBatch]:
    """The vectors as the bytes of whole numbers, with their width and squared length; unfit ones are left out."""
    for batch in batches:
        out = []
        for row, vec_id, vector in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            if not vector.is_valid or vector.values.null_count:
                continue
            values = np.floor(scale * vector.values.to_numpy(zero_copy_only=False).astype("float64"))
            if not np.isfinite(vector.values.to_numpy(zero_copy_only=False)).all():
                continue
            values = np.clip(values, -LARGEST, LARGEST).astype("int64")
            kind = next(t for t in ("int8", "int16", "int32") if not len(values) or np.abs(values).max() <= np.iinfo(t).max)
            norm = float(np.square(values.astype("float64")).sum())
            out.append((row.as_py(), vec_id.as_py(), values.astype(kind).tobytes(), np.dtype(kind).itemsize, norm))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.float64()), strict=True)],
            names=["row", "vec_id", "v", "width", "norm"],
        )


def matrix(side: pa.Table) -> np.ndarray:
    """The vectors as rows of doubles; a shorter one goes on with zeros."""
    found, widths = side.column("v").to_pylist(), side.column("width").to_numpy()
    dims = np.array([len(v) for v in found], dtype="int64") // widths
    out = np.zeros((len(found), int(dims.max(initial=0))))
    for width, length in {*zip(widths.tolist(), dims.tolist(), strict=True)}:
        at = np.nonzero((widths == width) & (dims == length))[0]
        out[at, :length] = np.frombuffer(b"".join(found[i] for i in at), f"<i{width}").reshape(len(at), length)
    return out


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All inner products as longs: exact, and cut to ``MOST`` where they are larger."""
    width = min(queries.shape[1], candidates.shape[1])
    queries, candidates = queries[:, :width], candidates[:, :width].T
    bound = width * np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0)
    if bound < EXACT:
        return (queries @ candidates).astype("int64")
    kind = "int64" if bound < MOST else object
    found = queries.astype("int64").astype(kind) @ candidates.astype("int64").astype(kind)
    return np.clip(found, -MOST, MOST).astype("int64")


def scored(queries: pa.Table, candidates: pa.Table) -> Iterator[tuple[slice, np.ndarray]]:
    """A cell's scores, some queries at a time; a query's own row scores below all others."""
    left, right, own = matrix(queries), matrix(candidates), candidates.column("row").to_numpy()
    rows = queries.column("row").to_numpy()
    for first in range(0, len(left), TOGETHER):
        part = slice(first, first + TOGETHER)
        found = scores(left[part], right)
        found[rows[part, None] == own[None, :]] = np.iinfo("int64").min
        yield part, found


def counted(queries: pa.Table, candidates: pa.Table, *, k: int, shift: int) -> pa.Table:
    """How many of the cell's k best scores of each query lie in each bin of its range.

    What a cell counts below its own k-th score cannot move the k-th score of all cells.
    """
    low, rows = queries.column("low").to_numpy(), queries.column("row").to_numpy()
    high, out = queries.column("high").to_numpy(), []
    for part, found in scored(queries, candidates):
        best = found if found.shape[1] <= k else np.partition(found, found.shape[1] - k, axis=1)[:, -k:]
        inside = (best >= low[part, None]) & (best <= high[part, None])
        bins = (best - np.where(inside, low[part, None], best)) >> shift
        query, at = np.nonzero(inside)
        out.append(np.stack([rows[part][query], bins[query, at]], axis=1))
    found, n = np.unique(np.concatenate(out or [np.empty((0, 2), "int64")]), axis=0, return_counts=True)
    return pa.table({"row": found[:, 0], "bin": found[:, 1], "n": n.astype("int64")})


def picked(queries: pa.Table, candidates: pa.Table, *, k: int) -> pa.Table:
    """The cell's scores above each query's k-th, and of those equal to it as many of the smallest ids as are wanted."""
    rows, low, above = (queries.column(c).to_numpy() for c in ("row", "low", "above"))
    candidates = candidates.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # NULLs last
    out = []
    for part, found in scored(queries, candidates):
        equal = found == low[part, None]
        wanted = (found > low[part, None]) | equal & (np.cumsum(equal, axis=1) <= k - above[part, None])
        query, at = np.nonzero(wanted)
        out.append((rows[part][query], at, found[query, at]))
    query, at, score = (np.concatenate([x[c] for x in out] or [np.empty(0, "int64")]) for c in range(3))
    own = candidates.take(at).select(["vec_id", "row"])
    return pa.table({"query": query, "vec_id": own.column(0), "row": own.column(1), "score": score})


def in_cells(queries: DataFrame, candidates: DataFrame, sizes: tuple[int, int], function, schema: str) -> DataFrame:
    """``function`` of every group of queries with every group of candidates; sizes is how many there are of each."""

    def dealt(rows: DataFrame, own: str, n: int, other: str, others: int) -> DataFrame:
        return rows.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n))).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        ).withColumns({name: F.col(name).cast("int") for name in (own, other)})

    left = dealt(queries, "i", sizes[0], "j", sizes[1]).groupBy("i", "j")
    right = dealt(candidates, "j", sizes[1], "i", sizes[0]).groupBy("i", "j")
    return left.cogroup(right).applyInArrow(function, schema)


def top_k(
    vectors: DataFrame, is_query: Column, *, k: int = 20, scale: float = 64.0, id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the ``k`` best of all other rows for each query row.

    Components become floor(scale * x), with x as a double; the score is the inner product of
    those whole numbers, exact. Equal scores stand by smaller vec_id, rows without an id last.
    ``is_query`` says of a row whether it is a query, by ``id_col``; NULL is no. Vectors that
    are NULL or hold a NULL, NaN or infinite component take no part. Every row is a row of its own: of rows that repeat
    an id each is a query and a candidate, also for one another. A shorter vector, also an empty
    one, goes on with zeros. Components beyond 31 bits and scores beyond 62 are cut to that. Fewer other
    rows than ``k`` are all returned. An empty table gives an empty result; other columns are ignored.

    A cell holds two groups of about ``CELL`` rows; there are at least as many groups of candidates as
    shuffle partitions. Per query and cell at most ``k`` counts or rows are shuffled. Copies of
    one vector, however many, are spread over all groups.
    """
    spark = vectors.sparkSession
    importable(spark)
    source = stage(spark, vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
        F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"),
    ), "vectors")
    rows = stage(spark, map_arrow(
        source.select("row", "vec_id", "v"), partial(packed, scale=scale), "row long, vec_id long, v binary, width int, norm double"
    ), "packed")
    n, norm = rows.agg(F.count(F.lit(1)), F.max("norm")).first()
    asked = rows.join(source.where("asks").select("row"), "row", "left_semi")
    asked = stage(spark, asked, "queries")
    n_asked, k = asked.count(), min(k, n - 1)
    schema = "query_id long, rank int, vec_id long, score long"
    if k < 1 or not n_asked:
        return spark.createDataFrame([], schema)
    sizes = -(-n_asked // CELL), max(parts_of(spark), -(-n // CELL))
    reach = min(MOST, math.ceil(norm * 1.000001) + 1)
    state = asked.select("row", F.lit(-reach).cast("long").alias("low"), F.lit(reach).cast("long").alias("high"), F.lit(0).cast("long").alias("above"))
    shift = (2 * reach + 1).bit_length()
    candidates, along = rows.drop("norm"), Window.partitionBy("row").orderBy(F.desc("bin"))
    while shift:
        shift = max(0, shift - BIN_BITS)
        counts = in_cells(
            asked.drop("norm", "vec_id").join(state, "row"), candidates, sizes, partial(counted, k=k, shift=shift), "row long, bin long, n long"
        ).groupBy("row", "bin").agg(F.sum("n").alias("n"))
        # The first bin from above with which the counts reach k.
        reached = counts.withColumn("upto", F.sum("n").over(along)).join(state, "row").where(
            (F.col("above") + F.col("upto") >= k) & (F.col("above") + F.col("upto") - F.col("n") < k)
        )
        low = F.col("low") + F.col("bin") * F.lit(1 << shift).cast("long")
        state = stage(spark, reached.select(
            "row", low.alias("low"), F.least(F.col("high"), low + F.lit((1 << shift) - 1).cast("long")).alias("high"),
            (F.col("above") + F.col("upto") - F.col("n")).alias("above"),
        ), "ranges")
    best = in_cells(
        asked.drop("norm", "vec_id").join(state, "row"), candidates, sizes, partial(picked, k=k),
        "query long, vec_id long, row long, score long",
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranks = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return ranks.join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
