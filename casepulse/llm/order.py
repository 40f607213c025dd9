"""Places of rows in a sort order, and running values along it, without a task that sees one whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casepulse.llm.common import parts_of
from casepulse.sources.writers import stage

#: Rows of a sorted part are numbered from its index shifted by so many bits.
PART_BITS = 33


def ranked(rows: DataFrame, within: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows``, a stored table, with at, tree and n_tree: places in the order of ``within`` and then ``order``.

    at counts all rows from 0; tree is the place of the first row that shares the values of
    ``within`` (NULL is a value, and comes first), n_tree the number of such rows. So at - tree is
    a row's place among those, and tree numbers them in their order.

    Rows are dealt into sorted ranges, so a key with any share of the rows spans many. The ranges'
    row counts, one for each shuffle partition, are broadcast; the rows of one key in one range
    find their key's start over both. Equal rows are told apart by a number of their own, only to
    spread them.
    """
    spark, parts, keys = rows.sparkSession, parts_of(rows.sparkSession), [*within, *order]
    placed = stage(
        spark,
        rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(parts, *keys, "_tie").sortWithinPartitions(*keys, "_tie")
        .withColumn("_id", F.monotonically_increasing_id()).drop("_tie"),
        "ranked",
    ).withColumn("_part", F.shiftright("_id", PART_BITS))
    spans = stage(spark, placed.groupBy("_part", *within).agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    ), "spans")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = spans.groupBy("_part").agg(F.sum("_n").alias("_size")).select(
        "_part", (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.shiftleft("_part", PART_BITS)).alias("_shift")
    )
    whole_key = Window.partitionBy(*(within or [F.lit(0)]))
    starts = spans.join(F.broadcast(before), "_part").select(
        F.col("_part").alias("_range"), "_shift", *(F.col(name).alias(f"_of_{k}") for k, name in enumerate(within)),
        F.min(F.col("_first") + F.col("_shift")).over(whole_key).alias("tree"),
        F.sum("_n").over(whole_key).alias("n_tree"),
    )
    same = F.col("_part") == F.col("_range")
    for k, name in enumerate(within):
        same = same & F.col(name).eqNullSafe(F.col(f"_of_{k}"))
    return placed.join(starts, same).select(
        *rows.columns, (F.col("_id") + F.col("_shift")).alias("at"), "tree", "n_tree"
    )


def running(
    rows: DataFrame, key: Sequence[str], place: str, values: dict[str, Column], *, block: int = 4096
) -> DataFrame:
    """``rows`` with running values up to and with each row, along ``place`` (whole numbers) in each key.

    ``values`` holds columns by name: a sum of longs, or with a name that starts with ``x_`` an
    exclusive or. A key is cut into blocks of places; inside a block a window runs, and the blocks'
    totals run along the key, so no task reads more of a key than a block or one row for each.
    """
    total = {name: (F.bit_xor if name.startswith("x_") else F.sum) for name in values}

    def add(name: str, a: Column, b: Column) -> Column:
        return a.bitwiseXOR(b) if name.startswith("x_") else a + b

    cut = rows.withColumn("_block", F.floor(F.col(place) / block).cast("long"))
    along = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(*key, "_block").agg(*(total[n](v).alias(f"_{n}") for n, v in values.items())).select(
        *key, "_block", *(F.coalesce(total[n](f"_{n}").over(along), F.lit(0)).alias(f"_{n}") for n in values)
    )
    inside = Window.partitionBy(*key, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = cut.withColumns({f"_own_{n}": total[n](v).over(inside) for n, v in values.items()})
    return own.join(before, [*key, "_block"]).select(
        *rows.columns, *(add(n, F.col(f"_own_{n}"), F.col(f"_{n}")).alias(n) for n in values)
    )
