"""Steady clients: today, yesterday and the day before side by side."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casepulse.functions.dates import (
    day_words,
    days,
    distinct_days,
    merged_words,
    positions_in,
    window_length,
)
from casepulse.functions.numbers import pct_diff, total

DATE = "case_receiving_date"


def daily_cases(daily: DataFrame, *, as_of: dt.date, window_days: int = 31) -> DataFrame:
    """Cases per client, name and day over the window that ends on as_of."""
    start = as_of - days(window_days - 1)
    return (
        daily.dropna(subset=["client_id", "client_name"])
        .filter(F.col(DATE).between(F.lit(start), F.lit(as_of)))
        .groupBy("client_id", "client_name", DATE)
        .agg(total("total_case").alias("total_cases"))
    )


def steady_clients(
    cases: DataFrame,
    *,
    as_of: dt.date,
    window_days: int = 31,
    min_days: int = 25,
    min_cases: int = 5,
    cohort_key: str = "client_name",
) -> DataFrame:
    """Keys active on more than ``min_days`` days with more than ``min_cases`` on each of them."""
    start = as_of - days(window_days - 1)
    return (
        cases.groupBy(cohort_key)
        .agg(
            distinct_days(F.col(DATE), start, as_of).alias("active_days"),
            F.min("total_cases").alias("min_cases"),
        )
        .filter((F.col("active_days") > min_days) & (F.col("min_cases") > min_cases))
        .select(cohort_key)
    )


def steady_client_comparison(
    daily: DataFrame,
    *,
    as_of: dt.date,
    window_days: int = 31,
    min_days: int = 25,
    min_cases: int = 5,
    cohort_key: str = "client_name",
) -> DataFrame:
    """Steady clients with cases on both earlier days, and the changes between the three days.

    The three days meet by client id, so a client that changed its name in between is still
    compared. One aggregate per client and name has the cohort's numbers and the three days; the
    cohort by name is one semi-join of its short result, that by id needs no join.
    """
    start, size = as_of - days(window_days - 1), window_length(as_of - days(window_days - 1), as_of)

    def on_day(back: int) -> Column:
        return F.max(F.when(F.col(DATE) == F.lit(as_of - days(back)), F.col("total_cases")))

    per_name = (
        daily_cases(daily, as_of=as_of, window_days=window_days)
        .groupBy("client_id", "client_name")
        .agg(
            day_words(F.col(DATE), start, as_of).alias("seen"),
            F.min("total_cases").alias("least"),
            *(on_day(back).alias(label) for back, label in enumerate(("today", "yesterday", "before"))),
        )
    )

    def steady(active: Column, least: Column) -> Column:
        return (positions_in(active) > min_days) & (least > min_cases)

    if cohort_key == "client_name":
        cohort = (
            per_name.groupBy("client_name")
            .agg(merged_words("seen", size).alias("seen"), F.min("least").alias("least"))
            .filter(steady(F.col("seen"), F.col("least")))
        )
        per_name = per_name.join(cohort.select("client_name"), "client_name", "left_semi")
        wanted = F.lit(True)
    else:
        wanted = steady(F.col("seen"), F.col("least"))

    def cases_on(label: str, *names: Column) -> Column:
        found = F.struct(*names, F.col(label).alias(f"total_cases_{label}"))
        return F.collect_list(F.when(F.col(label).isNotNull(), found)).alias(label)

    per_client = (
        per_name.groupBy("client_id")
        .agg(
            merged_words("seen", size).alias("seen"), F.min("least").alias("least"),
            cases_on("today"), cases_on("yesterday", F.col("client_name").alias("client_name_yesterday")),
            cases_on("before"),
        )
        .filter(wanted)
    )
    # Each client has few names, so its lists are short; a client without a day's cases has none.
    return (
        per_client.select("client_id", "today", "before", F.inline("yesterday"))
        .select("*", F.inline("before"))
        .select("*", F.inline_outer("today"))
        .withColumnRenamed("total_cases_before", "total_cases_day_before")
        .select(
            "client_id",
            "client_name_yesterday",
            "total_cases_today",
            "total_cases_yesterday",
            "total_cases_day_before",
            pct_diff("total_cases_today", "total_cases_yesterday").alias("drop_today_vs_yesterday"),
            pct_diff("total_cases_yesterday", "total_cases_day_before").alias(
                "drop_yesterday_vs_day_before"
            ),
            pct_diff("total_cases_today", "total_cases_day_before").alias("drop_today_vs_day_before"),
        )
    )
