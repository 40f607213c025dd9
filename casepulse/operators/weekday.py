"""Today against the same weekday of earlier weeks, by day, hour and interval."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casepulse.functions.dates import (
    distinct_positions,
    interval_label,
    same_weekday_dates,
    weekday_label,
)
from casepulse.functions.numbers import pct_diff, round_pct, total

TS = "case_receiving_date"


def _same_weekday_rows(cases: DataFrame, as_of: dt.date, weeks: int) -> DataFrame:
    """Rows of as_of's weekday, with the number of weeks back.

    The range is what the scan can use; the list picks the weekday.
    """
    wanted = same_weekday_dates(as_of, weeks)
    day = F.to_date(TS)
    return (
        cases.dropna(subset=["client_id", "client_name"])
        .filter(day.between(F.lit(wanted[-1]), F.lit(as_of)))
        .filter(day.isin(wanted))
        .withColumn("weeks_back", (F.datediff(F.lit(as_of), day) / 7).cast("int"))
    )


def same_weekday_drop(
    daily: DataFrame, *, as_of: dt.date, weeks: int = 4, include_silent: bool = False
) -> DataFrame:
    """Clients with fewer cases today than their mean over the same weekday of earlier weeks.

    The mean is over the days present. Today counts under the client's smallest historical
    name. A client without cases today is left out, or is at -100 % with ``include_silent``.
    """
    today = F.col("weeks_back") == 0
    past = F.col("weeks_back") > 0
    cases = F.col("total_case")
    per_name = (
        _same_weekday_rows(daily, as_of, weeks)
        .groupBy("client_id", "client_name")
        .agg(
            total(F.when(past, cases)).alias("past_cases"),
            distinct_positions(F.col("weeks_back") - 1, weeks).alias("past_days"),
            F.when(F.count_if(today) > 0, total(F.when(today, cases))).alias("today_cases"),
        )
    )
    past_name = F.when(F.col("past_days") > 0, F.col("client_name"))
    per_client = (
        per_name.groupBy("client_id")
        .agg(
            F.min(past_name).alias("client_name"),
            F.min_by("today_cases", past_name).alias("total_case"),
            F.try_divide(F.sum("past_cases"), F.sum("past_days")).alias("avg_cases_4w"),
        )
        .filter(F.col("client_name").isNotNull())
    )
    if include_silent:
        per_client = per_client.fillna(0, subset=["total_case"])
    return (
        per_client.withColumn("case_diff_pct", pct_diff("total_case", "avg_cases_4w"))
        .filter(F.col("case_diff_pct") < 0)
        .withColumn("case_diff_pct", round_pct(F.col("case_diff_pct")))
    )


def same_weekday_hourly(
    cases: DataFrame,
    *,
    as_of: dt.date,
    weeks: int = 4,
    divisor: str = "fixed",
    zero_baseline: float | None = 0.0,
) -> DataFrame:
    """Cases per client and hour today against the same weekday of earlier weeks.

    ``divisor='fixed'`` divides the past by ``weeks``, ``'present'`` by the days that have cases
    in that hour. An hour without past cases gets ``zero_baseline`` as its percentage.
    """
    today = F.col("weeks_back") == 0
    past = F.col("weeks_back") > 0
    past_sum = total(F.when(past, F.col("total_case")))
    if divisor == "present":
        average = F.coalesce(
            F.try_divide(past_sum, distinct_positions(F.col("weeks_back") - 1, weeks)), F.lit(0.0)
        )
    else:
        average = past_sum / F.lit(weeks)
    hourly = (
        _same_weekday_rows(cases, as_of, weeks)
        .groupBy("client_id", "client_name", F.hour(TS).alias("hour"))
        .agg(
            total(F.when(today, F.col("total_case"))).alias("case_count"),
            average.alias("avg_case_count"),
        )
    )
    new_hour = (F.col("avg_case_count") == 0) & (F.col("case_count") != 0)
    pct = F.when(new_hour, F.lit(zero_baseline).cast("double")).otherwise(
        round_pct(pct_diff("case_count", "avg_case_count"))
    )
    return hourly.withColumn("case_diff_pct", pct)


def _interval_days(cases: DataFrame, hours: int, *more: str) -> DataFrame:
    """Cases per client, day and time interval, and columns ``more`` of the cases."""
    day = F.to_date(TS)
    bucket = F.floor(F.hour(TS) / F.lit(hours)).cast("int")
    return (
        cases.dropna(subset=["client_id", TS])
        .groupBy("client_id", day.alias("day"), bucket.alias("bucket"), *more)
        .agg(total("total_case").alias("cases"))
    )


def interval_totals(cases: DataFrame, *, hours: int = 4) -> DataFrame:
    """Cases and number of days with any, per client, weekday and time interval.

    Both are sums over days, so totals of different days add up and a day can be taken back.
    """
    return _interval_days(cases, hours).groupBy("client_id", F.weekday("day").alias("weekday"), "bucket").agg(
        F.sum("cases").alias("cases"), F.count(F.lit(1)).alias("days")
    )


def replaced_totals(totals: DataFrame, old: DataFrame, new: DataFrame, *, hours: int = 4) -> DataFrame:
    """Totals after the cases ``old`` of some whole days became ``new``; both hold all cases of those days.

    Old and new days are summed together, the old ones under a minus sign, and then once with the totals.
    """
    columns = ("client_id", TS, "total_case")
    signed = old.select(*columns, F.lit(-1).cast("long").alias("days")).unionByName(
        new.select(*columns, F.lit(1).cast("long").alias("days"))
    )
    parts = totals.unionByName(_interval_days(signed, hours, "days").select(
        "client_id", F.weekday("day").alias("weekday"), "bucket", (F.col("cases") * F.col("days")).alias("cases"), "days"
    ))
    return parts.groupBy("client_id", "weekday", "bucket").agg(
        F.sum("cases").alias("cases"), F.sum("days").alias("days")
    ).filter("days > 0")


def baseline_of(totals: DataFrame, *, hours: int = 4) -> DataFrame:
    """Mean cases per client, weekday and time interval; rows group by numbers, labels are made once per row."""
    return totals.select(
        "client_id",
        weekday_label(F.col("weekday")).alias("Day of Week"),
        interval_label(F.col("bucket"), hours).alias("time_interval"),
        (F.col("cases") / F.col("days")).alias("average_cases"),
    )


def weekday_interval_baseline(cases: DataFrame, *, hours: int = 4) -> DataFrame:
    """Mean cases per client, weekday and time interval, over the days that have any."""
    return baseline_of(interval_totals(cases, hours=hours), hours=hours)
