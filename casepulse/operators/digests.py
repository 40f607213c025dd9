"""Order-free digests of parts of a table, to find the parts that have changed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Study ids in a block: rows that hang on a study have no day of their own.
BLOCK = 1 << 14
SUMS = ("rows", "low", "high")


def digest(df: DataFrame, by: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Rows and sums of both halves of the rows' hashes per part; sums of two tables' digests are their union's.

    A value's place in the row counts, and whether it is there.
    """
    marked = (field for name in columns for field in (F.col(name), F.col(name).isNull()))
    hashed = df.select(*by, F.xxhash64(*marked).alias("__hash"))
    keys = hashed.columns[:-1]
    return hashed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("__hash").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("low"),
        F.sum(F.shiftright("__hash", 32)).alias("high"),
    )


def changed(now: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The parts that are in one of two digests only, or differ."""
    signed = now.withColumn("__sign", F.lit(1)).unionByName(before.withColumn("__sign", F.lit(-1)))
    left = signed.groupBy(*keys).agg(*(F.sum(F.col(name) * F.col("__sign")).alias(name) for name in SUMS), F.sum("__sign").alias("__sign"))
    same = reduce(and_, (F.col(name) == 0 for name in (*SUMS, "__sign")))
    return left.filter(~same).select(*keys)


def id_block(study: str) -> Column:
    return F.floor(F.col(study) / BLOCK).alias("block")


def case_digests(studies: DataFrame, study_details: DataFrame, tat: DataFrame) -> DataFrame:
    """Digests by source, day (of studies; the other tables have none) and block of study ids.

    One scan a table, without a join: a row of a study's details changes its block, and the studies'
    own parts say which days have studies of a block.
    """
    none = F.lit(None).cast("date").alias("day")
    parts = (
        (studies, "studies", F.to_date("created_at").alias("day"), "id", ("id", "client_fk", "created_at", "status", "rules")),
        (study_details, "study_details", none, "study_fk", ("study_fk", "is_demo")),
        (tat, "client_tat_metrics", none, "study_id", ("study_id", "modality", "tat_min")),
    )
    return reduce(DataFrame.unionByName, (
        digest(df, [F.lit(source).alias("source"), day, id_block(study)], columns) for df, source, day, study, columns in parts
    ))


def changed_days(now: DataFrame, before: DataFrame) -> DataFrame:
    """The days whose cases may have changed between two case digests: day."""
    parts = changed(now, before, ["source", "day", "block"])
    own = F.col("source") == "studies"
    blocks = parts.filter(~own).select("block").distinct()
    known = now.filter(own).select("day", "block").union(before.filter(own).select("day", "block"))
    hung = known.join(blocks, "block", "left_semi").select("day")
    return parts.filter(own).select("day").union(hung).filter("day is not null").distinct()


def client_digests(clients: DataFrame, client_details: DataFrame, client_settings: DataFrame) -> DataFrame:
    """Digests by client and table of what the facts take from clients."""
    parts = (
        (clients, "id", ("client_name", "onboarded_at", "saas_only", "oms_partner")),
        (client_details, "client_fk", ("client_source",)),
        (client_settings, "client_fk", ("enable_demo", "billing_type")),
    )
    return reduce(DataFrame.unionByName, (
        digest(df, [F.lit(k).alias("source"), F.col(key).alias("client_fk")], columns) for k, (df, key, columns) in enumerate(parts)
    ))
