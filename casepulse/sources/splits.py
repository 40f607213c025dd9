"""Balanced splits of a database read: predicates that hold every row once, from counts of a key."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casepulse.sources.readers import conform, jdbc_options

# Buckets of a key that are counted to plan a split; what comes to the driver has so many rows at most.
BUCKETS = 4096


class Bucket(NamedTuple):
    """The smallest key of a bucket and its number of rows; a key is in the last bucket that starts at or below it."""

    start: Any
    rows: int


def literal(value: Any) -> str:
    """A key's value as SQL text."""
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.isoformat(' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, str):
        quoted = value.replace("'", "''")
        return f"'{quoted}'"
    return repr(value)


def cuts(buckets: Sequence[Bucket], parts: int) -> list[Any]:
    """Where all parts but the first start, ascending: at most ``parts - 1`` keys.

    A bucket belongs to the part in whose even share its first row falls. So parts differ from an even share by
    less than the largest bucket; a bucket of several shares is a part of its own and leaves fewer parts.
    """
    total, before, part, out = sum(b.rows for b in buckets), 0, 0, []
    for bucket in sorted(b for b in buckets if b.rows):
        own = before * parts // total
        if own > part:
            out.append(bucket.start)
        part, before = own, before + bucket.rows
    return out


def predicates(column: str, starts: Sequence[Any], *, nullable: bool = True) -> list[str]:
    """Disjoint conditions, one a part, that hold for every key once; the last one for rows without a key."""
    ends = [literal(start) for start in starts]
    found = [f"{column} >= {a} AND {column} < {z}" for a, z in zip(ends, ends[1:], strict=False)]
    if ends:
        found = [f"{column} < {ends[0]}", *found, f"{column} >= {ends[-1]}"]
    else:
        found = [f"{column} IS NOT NULL"]
    return [*found, f"{column} IS NULL"] if nullable else found


def width_for(least: int, largest: int, buckets: int = BUCKETS) -> int:
    """How many whole-number keys a bucket takes, so that there are ``buckets`` at most."""
    return -(-(largest - least + 1) // buckets)


def histogram_sql(source: str, column: str, least: int, width: int) -> str:
    """Counts the rows of each bucket of a whole-number key on the server; ``source`` is a table or a derived one."""
    bucket = f"{least} + {width} * FLOOR(({column} - {least}) / ({width} * 1.0))"
    return f"SELECT {bucket} AS start, COUNT(*) AS n_rows FROM {source} WHERE {column} IS NOT NULL GROUP BY {bucket}"


def histogram(df: DataFrame, column: str, buckets: int = BUCKETS) -> list[Bucket]:
    """The buckets of a whole-number key of a frame, counted by Spark; only ``buckets`` rows come to the driver."""
    least, largest = df.agg(F.min(column), F.max(column)).first()
    if least is None:
        return []
    width = width_for(least, largest, buckets)
    start = F.lit(least) + F.lit(width) * F.floor((F.col(column) - least) / width)
    counted = df.filter(F.col(column).isNotNull()).groupBy(start.cast("long").alias("start")).count()
    return [Bucket(*row) for row in counted.collect()]


def quantile_buckets(df: DataFrame, column: str, buckets: int = BUCKETS, accuracy: int = 100_000) -> list[Bucket]:
    """Buckets of about equal size of any ordered key that has quantiles: numbers, dates and times."""
    shares = [k / buckets for k in range(buckets)]
    found = df.agg(F.percentile_approx(column, shares, accuracy), F.count(column)).first()
    starts, rows = found[0] or [], found[1]
    each: dict[Any, int] = {}
    for k, start in enumerate(starts):
        each[start] = each.get(start, 0) + rows * (k + 1) // buckets - rows * k // buckets
    return [Bucket(start, n) for start, n in each.items()]


def split_predicates(df: DataFrame, column: str, parts: int, buckets: int = BUCKETS) -> list[str]:
    """Predicates of balanced parts for a key of a frame: a copy of the source, or an extract of its keys."""
    whole = isinstance(df.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    found = histogram(df, column, buckets) if whole else quantile_buckets(df, column, buckets)
    return predicates(column, cuts(found, parts))


def read_jdbc_balanced(
    spark: SparkSession, url: str, column: str, parts: int, *, table: str | None = None, query: str | None = None,
    schema: T.StructType | None = None, **options: Any,
) -> DataFrame:
    """A database read in balanced parts by a whole-number key: two short queries on the server plan it.

    Each part is a query of its own, so a snapshot over all parts is the server's matter.
    """
    source = table or f"({jdbc_options(url, query=query)['query']}) AS source"

    def ask(sql: str) -> DataFrame:
        return spark.read.format("jdbc").options(**jdbc_options(url, query=sql, **options)).load()

    least, largest = ask(f"SELECT MIN({column}) AS a, MAX({column}) AS z FROM {source}").first()
    found: list[Bucket] = []
    if least is not None:
        sql = histogram_sql(source, column, int(least), width_for(int(least), int(largest)))
        found = [Bucket(int(start), int(n)) for start, n in ask(sql).collect()]
    properties = {k: v for k, v in jdbc_options(url, table=source, **options).items() if k not in ("url", "dbtable")}
    df = spark.read.jdbc(url, source, predicates=predicates(column, cuts(found, parts)), properties=properties)
    return conform(df, schema) if schema else df
