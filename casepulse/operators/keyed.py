"""Join, filter and per-key helpers shared by the reports."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCHED, SALT, KEY, HOT = "__matched", "__salt", "__key", "__hot"

# Keys that a join spreads at most, each with more than one row in so many, and keys that the sketch follows.
HOT_KEYS, TRACKED = 1024, 16_384


def left_join_defaults(
    df: DataFrame, dim: DataFrame, on: Sequence[str], defaults: Mapping[str, Any]
) -> DataFrame:
    """Left join that fills the cells of unmatched rows with declared defaults, not NULL.

    A NULL that a matched row carries stays NULL.
    """
    joined = df.join(dim.withColumn(MATCHED, F.lit(True)), list(on), "left")
    filled = {
        name: F.when(F.col(MATCHED).isNull(), F.lit(value)).otherwise(F.col(name))
        for name, value in defaults.items()
    }
    return joined.withColumns(filled).drop(MATCHED)


def hot_keys(df: DataFrame, on: Sequence[str], parts: int) -> DataFrame:
    """Hashes (``__key``) of the keys that hold more than one row in ``parts``, or in HOT_KEYS if those are fewer.

    At most HOT_KEYS of them, from one aggregate with a sketch of frequent items, which combines on the map side. A key
    that is named by mistake does no harm; one with such a share is always named.
    """
    share = min(parts, HOT_KEYS)
    top = df.select(F.xxhash64(*on).alias(KEY)).agg(
        F.expr(f"approx_top_k({KEY}, {HOT_KEYS}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("rows")
    )
    return top.select("rows", F.inline("top")).filter(F.col("count") * share > F.col("rows")).select(
        F.col("item").alias(KEY)
    )


def _marked(df: DataFrame, on: Sequence[str], hot: DataFrame) -> DataFrame:
    return df.withColumn(KEY, F.xxhash64(*on)).join(F.broadcast(hot.withColumn(HOT, F.lit(True))), KEY, "left")


def copied_hot(left: DataFrame, on: Sequence[str], hot: DataFrame, parts: int) -> DataFrame:
    """Rows of hot keys once for each salt, others once."""
    salts = F.when(F.col(HOT), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return _marked(left, on, hot).withColumn(SALT, F.explode(salts)).drop(KEY, HOT)


def join_hot(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread_by: Sequence[str],
    parts: int | None = None, sizes: DataFrame | None = None,
) -> DataFrame:
    """Inner join for a right side in which one key may hold a large share of the rows.

    Right rows of hot keys are spread over ``parts`` parts by other columns, and only left rows of
    those keys are repeated for each part. Without a number of parts there are as many as shuffle
    partitions, so that a hot key fills all tasks of a cluster. What is hot is counted on the right side, or on
    ``sizes``, a table with about as many rows per key that is cheaper to read once more.
    """
    parts = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(right if sizes is None else sizes, on, parts)
    spread = _marked(right, on, hot).withColumn(
        SALT, F.when(F.col(HOT), F.pmod(F.xxhash64(*spread_by), F.lit(parts)).cast("int")).otherwise(0)
    ).drop(KEY, HOT)
    return copied_hot(left, on, hot, parts).join(spread, [*on, SALT]).drop(SALT)


def left_join_hot(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread_by: Sequence[str],
    parts: int | None = None, sizes: DataFrame | None = None,
) -> DataFrame:
    """Left join for a right side in which one key may hold a large share of the rows.

    The matches come from a spread inner join, the left rows without a match from an anti join
    against the distinct keys; an outer join could not split its right side.
    """
    keys = list(on)
    matched = join_hot(left, right, keys, spread_by, parts, sizes)
    unmatched = left.join(right.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def null_safe_left_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join in which a missing key matches a missing key."""
    renamed = right.withColumnsRenamed({key: f"__right_{key}" for key in on})
    condition = F.lit(True)
    for key in on:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__right_{key}"))
    return left.join(renamed, condition, "left").drop(*[f"__right_{key}" for key in on])


def without_ids(df: DataFrame, column: str, exclude: Sequence[int] | DataFrame | None) -> DataFrame:
    """Rows whose id is not excluded.

    A literal list becomes a scan filter; a one-column DataFrame of any size an anti join.
    """
    if exclude is None:
        return df
    if isinstance(exclude, DataFrame):
        ids = exclude.select(F.col(exclude.columns[0]).alias(column)).distinct()
        return df.join(ids, column, "left_anti")
    return df.filter(~F.col(column).isin(*sorted(set(exclude)))) if exclude else df


def last_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int
) -> DataFrame:
    """The first n rows of each key in the given order.

    The rank filter lets Spark cut every key to n rows before the shuffle as well.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("__rank", F.row_number().over(window))
    return ranked.filter(F.col("__rank") <= n).drop("__rank")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return last_n_per_key(df, keys, order, 1)


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, alias: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(ts).alias(alias))


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Drop the columns whose name matches the pattern at its start."""
    return df.select(*[F.col(f"`{name}`") for name in df.columns if not re.match(pattern, name)])


def column_or_default(df: DataFrame, name: str, default: Any = 0) -> Column:
    """The column where the frame has it, else the default."""
    return F.col(name) if name in df.columns else F.lit(default)


def only_keys(df: DataFrame, wanted: DataFrame, key: str, of: str | None = None) -> DataFrame:
    """Rows whose ``key`` is one of those in ``wanted`` (its column ``of``): cuts a table before it is summed."""
    return df.join(wanted.select(F.col(of or key).alias(key)), key, "left_semi")


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).dropna(subset=list(keys)).distinct()
