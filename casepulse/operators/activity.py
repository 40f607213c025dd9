"""Steady clients, tiered churn, and clients silent or low today."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casepulse.functions import text
from casepulse.functions.dates import (
    day_words,
    days,
    distinct_days,
    merged_words,
    positions_in,
    window_length,
)
from casepulse.functions.numbers import total
from casepulse.operators.keyed import join_hot, left_join_hot, only_keys
from casepulse.schemas import CHURN_TIERS, Tier

DATE = "case_receiving_date"


def _activity(start: dt.date, end: dt.date) -> list[Column]:
    """Active days and mean cases per fact row within [start, end]."""
    inside = F.col(DATE).between(F.lit(start), F.lit(end))
    return [
        distinct_days(F.col(DATE), start, end).alias("active_days"),
        F.avg(F.when(inside, F.col("total_case"))).alias("avg_case_load"),
    ]


def client_activity(
    daily: DataFrame, *, as_of: dt.date, lag_days: int = 3, window_days: int = 30
) -> DataFrame:
    """Active days and mean load per client in the window that ends ``lag_days`` before as_of."""
    end = as_of - days(lag_days)
    start = end - days(window_days - 1)
    return (
        daily.dropna(subset=["client_fk"])
        .filter(F.col(DATE).between(F.lit(start), F.lit(end)))
        .groupBy("client_fk")
        .agg(*_activity(start, end))
    )


def check_disjoint(tiers: Sequence[Tier]) -> None:
    ordered = sorted(tiers)
    for lower, upper in zip(ordered, ordered[1:]):
        if upper.min_days <= lower.max_days:
            raise ValueError(f"tiers overlap: {lower} and {upper}")


def churn_tiers(
    daily: DataFrame,
    *,
    as_of: dt.date,
    tiers: Sequence[Tier] = CHURN_TIERS,
    min_avg_load: float = 5,
    lag_days: int = 3,
    window_days: int = 30,
) -> DataFrame:
    """Steady clients that went quiet, by tier.

    A tier holds clients with so many active days in the window and no case on any of the last
    ``silent_days`` days before as_of; cases on as_of itself do not count. Being silent for k
    days means that the last day seen lies before as_of - k, so one aggregate per client
    answers all tiers at once.
    """
    check_disjoint(tiers)
    end = as_of - days(lag_days)
    start = end - days(window_days - 1)
    yesterday = as_of - days(1)
    reach = as_of - days(max(tier.silent_days for tier in tiers))
    recent = F.col(DATE).between(F.lit(reach), F.lit(yesterday))
    facts = (
        daily.dropna(subset=["client_fk"])
        .filter(F.col(DATE).between(F.lit(min(start, reach)), F.lit(max(end, yesterday))))
        .groupBy("client_fk")
        .agg(*_activity(start, end), F.max(F.when(recent, F.col(DATE))).alias("last_seen"))
        .filter(F.col("avg_case_load") > min_avg_load)
    )
    return in_tiers(facts, as_of=as_of, tiers=tiers)


def in_tiers(facts: DataFrame, *, as_of: dt.date, tiers: Sequence[Tier]) -> DataFrame:
    """The clients of ``facts`` (client_fk, active_days, avg_case_load, last_seen) that are in a tier."""
    active_type = category = F.lit(None).cast("string")
    for tier in tiers:
        silent = F.col("last_seen").isNull() | (
            F.col("last_seen") < F.lit(as_of - days(tier.silent_days))
        )
        in_tier = F.col("active_days").between(tier.min_days, tier.max_days) & silent
        active_type = F.when(in_tier, tier.client_active_type).otherwise(active_type)
        category = F.when(in_tier, tier.churn_category).otherwise(category)
    return facts.select(
        "client_fk",
        "active_days",
        "avg_case_load",
        active_type.alias("client_active_type"),
        category.alias("churn_category"),
    ).filter(F.col("churn_category").isNotNull())


def silent_clients(daily: DataFrame, *, as_of: dt.date, window_days: int = 30) -> DataFrame:
    """Clients with a case in the window that ended yesterday and none on as_of."""
    past = F.col(DATE) < F.lit(as_of)
    per_name = (
        daily.dropna(subset=["client_fk"])
        .filter(F.col(DATE).between(F.lit(as_of - days(window_days)), F.lit(as_of)))
        .groupBy("client_fk", "client_name")
        .agg(F.count_if(past).alias("past_rows"), F.count_if(~past).alias("rows_today"))
    )
    # A client may have had several names; today's may differ from all of them.
    names = F.collect_set(F.when(F.col("past_rows") > 0, F.struct("client_name")))
    return (
        per_name.groupBy("client_fk")
        .agg(names.alias("names"), F.sum("rows_today").alias("rows_today"))
        .filter("rows_today = 0")
        .select("client_fk", F.inline("names"))
    )


def silent_directory(silent: DataFrame, contacts: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Silent clients with their contacts, phones as stored; clients without contacts stay.

    ``sizes`` (column client_fk) may tell the clients with many contacts in place of the directory.
    """
    people = only_keys(
        contacts.select("client_fk", "contact_fk", "unique_id", "phone_number"), silent, "client_fk"
    )
    listed = left_join_hot(silent, people, ["client_fk"], ["contact_fk"], sizes=sizes)
    return _silent_columns(listed)


def silent_contacts(silent: DataFrame, contacts: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Contacts of silent clients that have a phone, cleaned.

    Only rows with a phone remain, so an inner join suffices. An empty phone is kept.
    """
    people = contacts.select("client_fk", "contact_fk", "unique_id", "phone_number").filter(
        F.col("phone_number").isNotNull()
    )
    listed = join_hot(silent, people, ["client_fk"], ["contact_fk"], sizes=sizes)
    return _silent_columns(
        listed.withColumn("phone_number", text.clean_phone(F.col("phone_number")))
    )


def _silent_columns(listed: DataFrame) -> DataFrame:
    return listed.select(
        "client_fk",
        F.col("client_name").alias("Client_Name"),
        "contact_fk",
        "unique_id",
        "phone_number",
    )


def daily_volume(
    daily: DataFrame, *, as_of: dt.date, min_avg_load: float = 2, window_days: int = 30
) -> DataFrame:
    """Activity up to yesterday next to today's cases, for clients above the load limit.

    ``cases_today`` is NULL for a client without a row today.
    """
    start, end = as_of - days(window_days), as_of - days(1)
    inside = F.col(DATE).between(F.lit(start), F.lit(end))
    today = F.col(DATE) == F.lit(as_of)
    cases = F.col("total_case")
    # The name is a key of the first aggregate, which so stays a hash aggregate; only its short
    # result is sorted for the smallest name.
    per_name = (
        daily.dropna(subset=["client_fk"])
        .filter(F.col(DATE).between(F.lit(start), F.lit(as_of)))
        .groupBy("client_fk", "client_name")
        .agg(
            day_words(F.col(DATE), start, end).alias("seen"),
            F.count_if(inside).alias("past_rows"),
            F.sum(F.when(inside, cases)).alias("cases"),
            F.count(F.when(inside, cases)).alias("rows"),
            F.when(F.count_if(today) > 0, total(F.when(today, cases))).alias("cases_today"),
        )
    )
    return (
        per_name.groupBy("client_fk")
        .agg(
            positions_in(merged_words("seen", window_length(start, end))).alias("active_days"),
            F.try_divide(F.sum("cases"), F.sum("rows")).alias("avg_case_load"),
            F.min(F.when(F.col("past_rows") > 0, F.col("client_name"))).alias("client_name"),
            F.sum("cases_today").alias("cases_today"),
        )
        .filter(F.col("avg_case_load") > min_avg_load)
    )


_WATCH = ("client_fk", "active_days", "avg_case_load", "client_name")


def zero_cases_today(daily: DataFrame, **options) -> DataFrame:
    """Clients above the load limit without any case today."""
    return daily_volume(daily, **options).filter(F.col("cases_today").isNull()).select(*_WATCH)


def full_activity_no_cases(
    daily: DataFrame, *, window_days: int = 30, min_active_days: int | None = None, **options
) -> DataFrame:
    """As above, but only clients active on every day of the window."""
    needed = window_days if min_active_days is None else min_active_days
    quiet = zero_cases_today(daily, window_days=window_days, **options)
    return quiet.filter(F.col("active_days") >= needed)


def low_activity_today(
    daily: DataFrame, *, share: float = 0.5, include_silent: bool = False, **options
) -> DataFrame:
    """Clients whose cases today are below the share of their mean load.

    Clients without any case today are reported by ``zero_cases_today``; ``include_silent``
    lists them here too, with 0 cases.
    """
    volume = daily_volume(daily, **options)
    if include_silent:
        volume = volume.fillna(0, subset=["cases_today"])
    return volume.filter(F.col("cases_today") < F.lit(share) * F.col("avg_case_load")).select(
        *_WATCH, "cases_today"
    )
