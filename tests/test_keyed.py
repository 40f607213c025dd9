from __future__ import annotations

import random

from pyspark.sql import functions as F

from casepulse.operators import keyed
from tests.conftest import rows_of


def test_defaults_fill_unmatched_rows_only(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    dim = spark.createDataFrame([(1, None, True)], "k long, name string, flag boolean")
    got = keyed.left_join_defaults(left, dim, ["k"], {"name": "", "flag": False})
    assert rows_of(got) == [(None, "", False), (1, None, True), (2, "", False)]


def test_a_flag_of_an_unmatched_row_passes_a_not_true_filter(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    dim = spark.createDataFrame([(1, True), (2, False)], "k long, demo boolean")
    filled = keyed.left_join_defaults(left, dim, ["k"], {"demo": False})
    assert rows_of(filled.filter(~F.col("demo")), "k") == [(2,), (3,)]


def test_hot_left_join_equals_a_left_join(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(k, f"l{i}") for i, k in enumerate([1, 1, 2, 3, 4, None])], "k long, a string")
    right = spark.createDataFrame(
        [(1, i) for i in range(300)] + [(rng.choice([2, 3, 9, None]), i) for i in range(100)], "k long, b long"
    )
    for parts in (None, 1, 50):
        got = keyed.left_join_hot(left, right, ["k"], ["b"], parts)
        assert rows_of(got, "k", "a", "b") == rows_of(left.join(right, "k", "left"), "k", "a", "b")
        got = keyed.join_hot(left, right, ["k"], ["b"], parts)
        assert rows_of(got, "k", "a", "b") == rows_of(left.join(right, "k"), "k", "a", "b")


def test_only_hot_keys_are_copied(spark):
    """A client with a third of the contacts is copied for each part; thousands of others are not."""
    left = spark.range(3000).withColumnRenamed("id", "k")
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 2999)
    right = spark.range(30_000).select(key.alias("k"), F.col("id").alias("b"))
    hot = keyed.hot_keys(right, ["k"], 200)
    assert rows_of(hot) == rows_of(spark.range(7, 8).select(F.xxhash64("id")))
    assert keyed.copied_hot(left, ["k"], hot, 200).count() == 2999 + 200
    joined = keyed.join_hot(left, right, ["k"], ["b"], 200)
    assert joined.count() == 30_000 and joined.columns == ["k", "b"]
    assert keyed.hot_keys(right.limit(0), ["k"], 200).count() == 0
    # Without a hot key nothing is copied; keys of several columns, also NULL ones, are counted as one.
    assert keyed.hot_keys(spark.range(30_000), ["id"], 200).count() == 0
    pairs = right.withColumn("none", F.lit(None).cast("string"))
    assert keyed.hot_keys(pairs, ["k", "none"], 200).count() == 1


def test_only_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k long, v string")
    wanted = spark.createDataFrame([(2,), (2,), (3,), (None,)], "id long")
    assert rows_of(keyed.only_keys(df, wanted, "k", "id")) == [(2, "b"), (2, "c")]


def test_null_keys_match_in_the_null_safe_join(spark):
    left = spark.createDataFrame([(1, None), (1, 2), (3, 4)], "a long, b long")
    right = spark.createDataFrame([(1, None, "x"), (1, 2, "y"), (3, None, "z")], "a long, b long, c string")
    got = keyed.null_safe_left_join(left, right, ["a", "b"])
    assert rows_of(got) == [(1, None, "x"), (1, 2, "y"), (3, 4, None)]


def test_excluded_ids_as_list_and_as_table(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert rows_of(keyed.without_ids(df, "id", [2, 2])) == [(1,), (3,)]
    ids = spark.createDataFrame([(2,), (2,), (None,)], "gone long")
    assert rows_of(keyed.without_ids(df, "id", ids)) == [(1,), (3,)]
    assert keyed.without_ids(df, "id", []) is df
    assert keyed.without_ids(df, "id", None) is df


def test_last_rows_and_first_row_per_key(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1)], "k string, v long")
    assert rows_of(keyed.last_n_per_key(df, ["k"], [F.col("v").desc()], 4)) == [
        ("a", 5), ("a", 6), ("a", 7), ("a", 8), ("b", 1),
    ]
    assert rows_of(keyed.first_per_key(df, ["k"], [F.col("v")])) == [("a", 0), ("b", 1)]


def test_latest_and_distinct_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), (None, 5)], "k string, v long")
    assert rows_of(keyed.latest_per_key(df, ["k"], "v", "last")) == [(None, 5), ("a", 3), ("b", 2)]
    assert rows_of(keyed.distinct_keys(df, "k")) == [("a",), ("b",)]


def test_columns_by_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Unnamed: 0` long, Unnamed_1 long, x long")
    assert keyed.drop_matching(df, "^Unnamed").columns == ["x"]
    got = df.select(keyed.column_or_default(df, "x").alias("a"), keyed.column_or_default(df, "y").alias("b"))
    assert rows_of(got) == [(3, 0)]
