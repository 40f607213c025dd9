"""Exact deduplication: 128-bit content hash, smallest id stays, bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casepulse.llm.common import SPACE, join_groups, whole
from casepulse.sources.writers import stage


def one_spaced(text: Column) -> Column:
    """The text with each run of white space as one space; NULL is the empty text."""
    return F.regexp_replace(whole(text), SPACE, " ")


def content_hash(text: Column) -> Column:
    """The first 128 bits of the SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def exact_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    normal: Callable[[Column], Column] = one_spaced,
    digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """Which row of each set of equal texts stays.

    One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normal
    text). Rows are grouped by the hash and then by the bytes of the text, in one aggregate that
    combines copies before it shuffles, so texts with one hash are told apart. Groups come back
    to the rows by the full SHA-256; should two texts ever share it, the job stops with an error.

    A NULL text counts as empty. Rows without an id never win over rows with one; a group of
    only such rows has a NULL keep_id and keeps them all. Rows that repeat an id with its text
    count in group_size and are reported alike. Other columns of ``docs`` are ignored. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normal(F.col(text_col)).alias("_text"))
    classes = rows.groupBy(digest(F.col("_text")).alias("_hash"), "_text").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    groups = classes.groupBy("_hash", F.unhex(F.sha2("_text", 256)).alias("_sha")).agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"),
        F.count(F.lit(1)).alias("_texts"),
    ).select(
        "_sha", "keep_id",
        F.when(F.col("_texts") > 1, F.raise_error(F.lit("two texts share a SHA-256")).cast("long"))
        .otherwise(F.col("group_size")).alias("group_size"),
    )
    groups = stage(docs.sparkSession, groups, "exact-groups")
    light = rows.select("doc_id", F.unhex(F.sha2("_text", 256)).alias("_sha"))
    return join_groups(light, groups, ["_sha"], size="group_size", spread=["doc_id"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
