"""Tables from files and from SQL databases, checked against the declared schemas."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casepulse.schemas import SCHEMAS


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in the declared types; a missing column is an error."""
    missing = [name for name in schema.names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(field.name).cast(field.dataType) for field in schema])


def read_files(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet", **options: Any
) -> DataFrame:
    """Files of one format. CSV gets the declared schema up front and is never scanned to guess it."""
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.option("header", True)
        return reader.schema(schema).load(path) if schema else reader.load(path)
    df = reader.load(path)
    return conform(df, schema) if schema else df


def read_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One of the declared input tables below a folder."""
    return read_files(spark, f"{folder}/{name}.{fmt}", SCHEMAS[name], fmt)


def jdbc_options(
    url: str,
    *,
    query: str | None = None,
    table: str | None = None,
    partition_column: str | None = None,
    lower: Any = None,
    upper: Any = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
    **extra: Any,
) -> dict[str, str]:
    """Options of a JDBC read.

    A query runs on the server as written and arrives through one connection. A range over a
    numeric or date column splits the read; it needs the query as a derived table.
    """
    if (query is None) == (table is None):
        raise ValueError("give either a query or a table")
    options = {"url": url, "fetchsize": str(fetch_size), **{k: str(v) for k, v in extra.items()}}
    if partition_column is None:
        options["query" if query else "dbtable"] = (query or table).strip().rstrip(";")
        return options
    if None in (lower, upper, partitions):
        raise ValueError("a split read needs lower, upper and partitions")
    inner = query.strip().rstrip(";") if query else None
    return options | {
        "dbtable": f"({inner}) AS source" if inner else table,
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def read_jdbc(spark: SparkSession, url: str, schema: T.StructType | None = None, **options: Any) -> DataFrame:
    """Result of a query or table of a SQL database."""
    df = spark.read.format("jdbc").options(**jdbc_options(url, **options)).load()
    return conform(df, schema) if schema else df


def read_sql_file(spark: SparkSession, url: str, path: str, **options: Any) -> DataFrame:
    """Result of the query held in a local SQL file."""
    with open(path, encoding="utf-8") as handle:
        return read_jdbc(spark, url, query=handle.read(), **options)
