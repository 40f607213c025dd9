"""Splits hold every key once and are even but for one bucket."""

from __future__ import annotations

import datetime as dt
from bisect import bisect_right

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casepulse.sources import splits
from casepulse.sources.splits import Bucket


def part_of(key, starts):
    """The conditions that hold for a key, by a database."""
    found = splits.predicates("k", starts)
    value = "NULL" if key is None else splits.literal(key)
    sql = ", ".join(f"coalesce({p}, false)" for p in found)
    return [n for n, holds in enumerate(duckdb.sql(f"SELECT {sql} FROM (SELECT {value} AS k)").fetchall()[0]) if holds]


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(-50, 50), st.integers(0, 40), max_size=40), st.integers(1, 12))
def test_parts_are_even_but_for_a_bucket(counts, parts):
    starts = splits.cuts([Bucket(*item) for item in counts.items()], parts)
    assert starts == sorted(set(starts)) and len(starts) < parts
    sizes = [0] * (len(starts) + 1)
    for key, n in counts.items():
        sizes[bisect_right(starts, key)] += n
    total, largest = sum(counts.values()), max(counts.values(), default=0)
    assert sum(sizes) == total
    # One bucket of several shares leaves fewer parts; else each is an even share, but for less than one bucket.
    assert all(size < total / parts + largest for size in sizes) or total == 0
    if largest * parts <= total:
        assert len(sizes) == parts or total == 0
        assert max(sizes) - min(sizes) <= 2 * largest


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-20, 20), unique=True, max_size=5).map(sorted), st.one_of(st.none(), st.integers(-25, 25)))
def test_every_key_is_in_one_part(starts, key):
    assert len(part_of(key, starts)) == 1


@pytest.mark.parametrize("keys", [["a'b", "b", "c"], [dt.date(2024, 1, 1), dt.date(2024, 2, 1), dt.date(2025, 1, 1)], [1.5, 2.5, 9.0], [dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 2), dt.datetime(2024, 3, 1)]])
def test_keys_of_other_types(keys):
    assert [part_of(key, keys[1:]) for key in (*keys, None)] == [[0], [1], [2], [3]]


def test_without_a_key_or_rows():
    assert splits.predicates("k", [], nullable=False) == ["k IS NOT NULL"]
    assert splits.cuts([], 4) == [] and splits.cuts([Bucket(1, 0)], 4) == []


def test_the_server_counts_the_same_buckets(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id") % 977 - 300).alias("k"))
    keys = [(row.k,) for row in df.collect()]
    least, largest = min(keys)[0], max(keys)[0]
    width = splits.width_for(least, largest, 50)
    db = duckdb.connect()
    db.execute("CREATE TABLE t (k BIGINT)")
    db.executemany("INSERT INTO t VALUES (?)", [*keys[:], (None,)])
    counted = db.sql(splits.histogram_sql("t", "k", least, width)).fetchall()
    assert sorted((int(a), n) for a, n in counted) == sorted(splits.histogram(df, "k", 50))
    found = splits.predicates("k", splits.cuts(splits.histogram(df, "k", 50), 4))
    sizes = [db.sql(f"SELECT count(*) FROM t WHERE {p}").fetchall()[0][0] for p in found]
    assert sum(sizes) == 1001 and sizes[-1] == 1 and max(sizes[:-1]) - min(sizes[:-1]) <= 2 * max(n for _, n in counted)


def test_quantiles_split_times(spark):
    start = dt.datetime(2024, 1, 1)
    df = spark.range(1200).select((F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id") * F.col("id"))).alias("at"))
    found = splits.split_predicates(df, "at", 6, buckets=60)
    sizes = [df.filter(p).count() for p in found]
    assert len(sizes) == 7 and sum(sizes) == 1200 and sizes[-1] == 0 and max(sizes[:-1]) - min(sizes[:-1]) <= 2 * 21
