"""Survey entries for churned contacts under a cool-down rule."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casepulse.operators.keyed import (
    distinct_keys,
    first_per_key,
    latest_per_key,
    null_safe_left_join,
)
from casepulse.schemas import CHURN_TIERS

ENTRY_COLUMNS = (
    "contact_fk", "client_fk", "client_active_type", "churn_type", "trigger", "created_at",
    "updated_at",
)
CREATED_COLUMNS = ("created_id", "contact_fk", "client_fk", "trigger", "created_at")

# Days a contact is left alone after an entry.
COOLDOWN_DAYS = 7

# Hex digits of the key hash that number an id block: 16**3 blocks, whatever the data size.
BLOCK_DIGITS = 3


def timestamp(value: dt.datetime) -> Column:
    return F.lit(value.isoformat(" ")).cast("timestamp_ntz")


def survey_history(client_survey: DataFrame) -> DataFrame:
    return client_survey.select(
        F.to_date("created_at").alias("Date"),
        F.col("id").alias("survey_id"),
        "client_fk",
        F.col("contact_fk").alias("contact_id"),
        "client_active_type",
        "churn_type",
        "response",
        "trigger",
    )


def survey_entries(
    reachable: DataFrame,
    survey_log: DataFrame,
    *,
    as_of_ts: dt.datetime,
    cooldown_days: int = COOLDOWN_DAYS,
    dedup_keys: Sequence[str] = ("contact_fk",),
    cooldown_on: str = "any",
    tier_order: Sequence[str] = tuple(tier.churn_category for tier in CHURN_TIERS),
) -> DataFrame:
    """One entry per contact, triggered unless its last entry lies within the cool-down.

    A contact listed twice keeps the row of the first tier, then of the smallest client.
    The cool-down is one of ``dedup_keys`` too: with client and contact, an entry for a contact of
    one client does not hold back another client's. ``cooldown_on='triggered'`` counts only
    earlier entries that were triggered themselves.
    Only entries before ``as_of_ts`` count, so a repeated run decides as the first one did.
    """
    tier_rank = F.array_position(F.array(*[F.lit(name) for name in tier_order]), F.col("churn_type"))
    known_last = F.when(tier_rank > 0, tier_rank).otherwise(len(tier_order) + 1)
    kept = first_per_key(
        reachable.select("contact_fk", "client_fk", "client_active_type", "churn_type"),
        dedup_keys,
        [known_last, F.col("client_fk"), F.col("contact_fk")],
    )
    now = timestamp(as_of_ts)
    limit = timestamp(as_of_ts - dt.timedelta(days=cooldown_days))
    # The last entry is older than the limit exactly when there is none since, so only the
    # entries of the cool-down are read, not the whole log.
    recent = survey_log.filter((F.col("created_at") >= limit) & (F.col("created_at") < now))
    if cooldown_on == "triggered":
        recent = recent.filter("trigger")
    held_back = distinct_keys(recent, *dedup_keys).withColumn("__recent", F.lit(True))
    # A missing contact finds no earlier entry, as '=' never matches it.
    return (
        kept.join(held_back, list(dedup_keys), "left")
        .withColumns(
            {"trigger": F.col("__recent").isNull(), "created_at": now, "updated_at": now}
        )
        .select(*ENTRY_COLUMNS)
    )


def last_entries(survey_log: DataFrame) -> DataFrame:
    """Time of each contact's last entry."""
    return latest_per_key(survey_log, ["contact_fk"], "created_at", "last_created_at")


def id_block(client_fk: Column, contact_fk: Column) -> Column:
    """A fixed number of even blocks, so that neither a hot client nor contact fills one."""
    missing = F.lit("")
    key = F.concat(
        F.coalesce(client_fk.cast("string"), missing),
        F.lit(":"),
        F.coalesce(contact_fk.cast("string"), missing),
    )
    return F.substring(F.md5(key), 1, BLOCK_DIGITS)


def _held(survey_log: DataFrame, as_of_ts: dt.datetime) -> DataFrame:
    """The entries of ``as_of_ts`` that the log already has: client_fk, contact_fk, held_id."""
    own = survey_log.filter(F.col("created_at") == timestamp(as_of_ts))
    return own.groupBy("client_fk", "contact_fk").agg(F.min("id").alias("held_id"))


def with_created_id(
    entries: DataFrame, survey_log: DataFrame, *, as_of_ts: dt.datetime, last_id: int | None = None
) -> DataFrame:
    """Entries with their ids: that of the log if it holds the entry, else the next ones after it.

    An entry is held if the log has its client and contact at ``as_of_ts``, from an earlier attempt
    of the same run; its id is in use and stays, whatever else has changed since. The others go on
    from the largest id of the whole log. They are numbered inside hash blocks and every block
    starts where the ones before it end; only the block sizes, at most 16**BLOCK_DIGITS rows, meet
    in one task.
    """
    known = null_safe_left_join(entries, _held(survey_log, as_of_ts), ["client_fk", "contact_fk"])
    held = known.filter("held_id is not null").select(F.col("held_id").alias("created_id"), *entries.columns)
    blocks = known.filter("held_id is null").withColumn(
        "__block", id_block(F.col("client_fk"), F.col("contact_fk"))
    )
    in_block = Window.partitionBy("__block").orderBy("client_fk", "contact_fk")
    numbered = blocks.withColumn("__row", F.row_number().over(in_block))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocks.groupBy("__block")
        .agg(F.count(F.lit(1)).alias("__size"))
        .select("__block", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    )
    known_id = F.lit(last_id).cast("long") if last_id is not None else survey_log.agg(F.max("id")).scalar()
    new = numbered.join(F.broadcast(starts), "__block").select(
        (F.coalesce(known_id, F.lit(0)) + F.col("__start") + F.col("__row")).alias("created_id"), *entries.columns
    )
    return held.unionByName(new)


def new_entries(
    created: DataFrame, survey_log: DataFrame, *, as_of_ts: dt.datetime
) -> DataFrame:
    """Entries the log does not hold yet, in the log's layout; a repeated run adds nothing."""
    known = null_safe_left_join(created, _held(survey_log, as_of_ts), ["client_fk", "contact_fk"])
    return known.filter("held_id is null").select(
        F.col("created_id").alias("id"),
        "contact_fk",
        "client_fk",
        "client_active_type",
        "churn_type",
        F.lit(None).cast("string").alias("response"),
        "trigger",
        "created_at",
        "updated_at",
    )


def survey_merged(created: DataFrame, reachable: DataFrame) -> DataFrame:
    """Created entries with the contact and modality data of their contact."""
    return null_safe_left_join(
        created.select(*CREATED_COLUMNS), reachable, ["client_fk", "contact_fk"]
    )


def survey_to_notify(merged: DataFrame) -> DataFrame:
    return merged.filter("trigger")
