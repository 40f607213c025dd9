"""What the operators share: joins to groups with hot keys, text patterns, spare names."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run of white space, and a word, as Java and Python patterns.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Keys that ``join_groups`` spreads at most. Any further key has less than one row in so many.
HEAVY = 1024
#: Bytes of an Arrow batch; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def importable(spark: SparkSession) -> None:
    """Lets Python workers on machines that have this package in the same folder import it.

    Where it is installed, or shipped with ``--py-files``, that is found first or as well.
    """
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([*filter(None, paths), root])


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the Arrow batches that go to Python workers, where the session allows more."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = "".join(filter(str.isdigit, spark.conf.get(setting))) or "0"
    if not 0 < int(given) <= BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def map_arrow(df: DataFrame, function: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with workers that can import this package and get small batches."""
    importable(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: Column | str) -> Column:
    """A text, NULL as the empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def spare(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not use."""
    used = {column.lower() for column in df.columns}
    while name in used:
        name += "_"
    return name


def settled(df: DataFrame) -> DataFrame:
    """The same rows, with every column computed once.

    A filter on a computed column is else pushed below it, with the expression in place of the
    column; inside the lambda of an array function it would be computed again for each element.
    """
    return df.select(F.inline(F.array(F.struct("*"))))


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_groups(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], *, size: str, spread: Sequence[str],
    heavy: int = HEAVY, sizes: DataFrame | None = None, value: str | None = None,
) -> DataFrame:
    """``rows`` joined to ``groups``, which has one row per key and its number of rows in ``size``.

    The ``heavy`` largest groups are known by a top-k, so the table of their keys is bounded
    whatever the input; it is broadcast to give their rows a salt out of ``spread``, and only
    those groups are copied once per salt. No other key holds a share of the rows that matters.
    The sizes may come from another table, ``sizes``; it is read twice and should be a stored one.
    ``groups`` may repeat its keys if all rows of a key agree in their one other column, ``value``.
    """
    parts, keys = parts_of(rows.sparkSession), list(keys)
    hot = (groups if sizes is None else sizes).where(F.col(size) > parts).orderBy(F.desc(size)).limit(heavy).select(
        *keys, F.lit(True).alias("_hot")
    )
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(parts))).otherwise(F.lit(0)).cast("int")
    ).drop("_hot")
    copies = groups.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt",
        F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))),
    ).drop("_hot")
    if value:
        copies = copies.groupBy(*keys, "_salt").agg(F.first(value).alias(value))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")
