"""Today against yesterday, the same weekday, the week and the month.

``grain='client_day'`` (default) sums a client's rows of one day first; ``grain='row'`` takes
fact rows as they are. Both agree when the fact holds one row per client and day.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casepulse.functions.dates import days, distinct_positions, monday_of
from casepulse.functions.numbers import pct_diff, total
from casepulse.operators.keyed import last_n_per_key

DATE = "case_receiving_date"
CASES = "total_case"


class Period(NamedTuple):
    """Days a comparison takes, the number of the week or month each falls into, and a bound of it."""

    rows: Column
    position: Column
    size: int


def _day() -> Column:
    return F.col(DATE)


def _week_rows(as_of: dt.date) -> Column:
    return _day().between(F.lit(monday_of(as_of)), F.lit(as_of))


def _month_rows(as_of: dt.date, year_aware: bool) -> Column:
    if year_aware:
        return _day().between(F.lit(as_of.replace(day=1)), F.lit(as_of))
    return F.month(_day()) == as_of.month


def _months_period(as_of: dt.date, year_aware: bool) -> Period:
    if not year_aware:
        rows = (_day() < F.lit(as_of)) & (F.month(_day()) >= as_of.month - 3)
        return Period(rows, F.month(_day()), 13)
    first = F.lit(as_of.replace(day=1))
    start = F.add_months(first, -3)
    rows = (_day() >= start) & (_day() < first)
    return Period(rows, F.floor(F.months_between(F.trunc(_day(), "month"), start)), 3)


def _weeks_period(as_of: dt.date, whole_weeks: bool) -> Period:
    if whole_weeks:
        monday = monday_of(as_of)
        rows = _day().between(F.lit(monday - days(21)), F.lit(monday - days(1)))
    else:
        rows = _day().between(F.lit(as_of - days(28)), F.lit(as_of - days(1)))
    return Period(rows, F.weekofyear(_day()), 54)


def _mean_per_period(period: Period) -> Column:
    """Aggregate: mean over the periods present of the cases per period."""
    cases = total(F.when(period.rows, F.col(CASES)))
    return F.try_divide(cases, distinct_positions(F.when(period.rows, period.position), period.size))


def _days(daily: DataFrame, grain: str) -> DataFrame:
    """Fact at the wanted grain: client_id, day, total_case."""
    known = daily.dropna(subset=["client_id"]).select("client_id", DATE, CASES)
    if grain == "row":
        return known
    return known.groupBy("client_id", DATE).agg(total(CASES).alias(CASES))


def last_same_weekdays(
    daily: DataFrame, *, as_of: dt.date, n: int = 4, grain: str = "client_day"
) -> DataFrame:
    """Mean cases over the last n rows before as_of on its weekday, however old they are."""
    past = daily.filter(_day() < F.lit(as_of)).filter(F.weekday(_day()) == as_of.weekday())
    order = [F.col(DATE).desc(), F.col(CASES).desc()]
    latest = last_n_per_key(_days(past, grain), ["client_id"], order, n)
    return latest.groupBy("client_id").agg(F.avg(CASES).alias("avg_case_count_last_4_weeks"))


def yesterday_cases(
    daily: DataFrame, *, as_of: dt.date, grain: str = "client_day"
) -> DataFrame:
    rows = daily.filter(_day() == F.lit(as_of - days(1)))
    return _days(rows, grain).select("client_id", F.col(CASES).alias("yesterday_case_count"))


def today_cases(daily: DataFrame, *, as_of: dt.date, grain: str = "client_day") -> DataFrame:
    rows = daily.filter(_day() == F.lit(as_of))
    if grain == "row":
        return rows.select("client_id", "client_name", F.col(CASES).alias("today_case"))
    return (
        rows.dropna(subset=["client_id"])
        .groupBy("client_id")
        .agg(F.min("client_name").alias("client_name"), total(CASES).alias("today_case"))
    )


def _sum_of(daily: DataFrame, rows: Column, alias: str) -> DataFrame:
    known = daily.dropna(subset=["client_id"]).filter(rows)
    return known.groupBy("client_id").agg(total(CASES).alias(alias))


def _mean_of(daily: DataFrame, period: Period, alias: str) -> DataFrame:
    known = daily.dropna(subset=["client_id"]).filter(period.rows)
    return known.groupBy("client_id").agg(_mean_per_period(period).alias(alias))


def week_to_date(daily: DataFrame, *, as_of: dt.date) -> DataFrame:
    """Cases from Monday to as_of."""
    return _sum_of(daily, _week_rows(as_of), "week_case_count")


def month_cases(daily: DataFrame, *, as_of: dt.date, year_aware: bool = False) -> DataFrame:
    """Cases of as_of's calendar month, in every year unless ``year_aware``."""
    return _sum_of(daily, _month_rows(as_of, year_aware), "month_case_count")


def last_3_months(daily: DataFrame, *, as_of: dt.date, year_aware: bool = False) -> DataFrame:
    """Mean cases per month over months numbered from as_of's month - 3 on, in every year.

    With ``year_aware`` over the three whole months before as_of's.
    """
    return _mean_of(daily, _months_period(as_of, year_aware), "avg_case_count_last_3_months")


def last_3_weeks(daily: DataFrame, *, as_of: dt.date, whole_weeks: bool = False) -> DataFrame:
    """Mean cases per ISO week over the 28 days before as_of, partial weeks included.

    With ``whole_weeks`` over the three whole weeks before as_of's.
    """
    return _mean_of(daily, _weeks_period(as_of, whole_weeks), "avg_case_count_last_3_weeks")


def drop_percentages(report: DataFrame) -> DataFrame:
    """The four changes of a report; NULL where the baseline is missing or 0."""
    return report.withColumns(
        {
            "drop_percentage_today": pct_diff("today_case", "yesterday_case_count"),
            "drop_percentage_4_weeks": pct_diff("today_case", "avg_case_count_last_4_weeks"),
            "drop_percentage_week": pct_diff("week_case_count", "avg_case_count_last_3_weeks"),
            "drop_percentage_month": pct_diff("month_case_count", "avg_case_count_last_3_months"),
        }
    )


def _single_pass_baselines(
    daily: DataFrame, as_of: dt.date, grain: str, year_aware: bool, whole_weeks: bool
) -> DataFrame:
    """All sums and period means from one aggregate per client.

    The names join from today's rows alone: a minimum over text would make Spark sort the whole
    history for this aggregate. At row grain yesterday's rows come as a list, and each of today's
    rows is listed once for each of them.
    """
    by_row = grain == "row"
    today = _day() == F.lit(as_of)
    yesterday = _day() == F.lit(as_of - days(1))
    week = _week_rows(as_of)
    month = _month_rows(as_of, year_aware)
    weeks = _weeks_period(as_of, whole_weeks)
    months = _months_period(as_of, year_aware)
    cases = F.col(CASES)
    summed = (
        daily.dropna(subset=["client_id"])
        .filter(today | yesterday | week | month | weeks.rows | months.rows)
        .groupBy("client_id")
        .agg(
            total(F.when(today, cases)).alias("today_case"),
            (
                F.collect_list(F.when(yesterday, F.struct(cases.alias("yesterday_case_count"))))
                if by_row
                else F.when(F.count_if(yesterday) > 0, total(F.when(yesterday, cases)))
            ).alias("yesterday_case_count"),
            total(F.when(week, cases)).alias("week_case_count"),
            total(F.when(month, cases)).alias("month_case_count"),
            _mean_per_period(weeks).alias("avg_case_count_last_3_weeks"),
            _mean_per_period(months).alias("avg_case_count_last_3_months"),
        )
    )
    last = last_same_weekdays(daily, as_of=as_of, grain=grain)
    if not by_row:
        names = today_cases(daily, as_of=as_of).select("client_id", "client_name")
        return names.join(summed, "client_id").join(last, "client_id", "left")
    rows = today_cases(daily, as_of=as_of, grain=grain)
    known = rows.join(summed.drop("today_case"), "client_id", "left").join(last, "client_id", "left")
    others = [c for c in known.columns if c != "yesterday_case_count"]
    return known.select(*others, F.inline_outer("yesterday_case_count"))


def trend_report(
    daily: DataFrame,
    *,
    as_of: dt.date,
    grain: str = "client_day",
    year_aware: bool = False,
    whole_weeks: bool = False,
) -> DataFrame:
    """One row per client with cases today: counts, baselines and the changes against them."""
    report = _single_pass_baselines(daily, as_of, grain, year_aware, whole_weeks)
    return drop_percentages(report).select(
        "client_id",
        "client_name",
        "today_case",
        "yesterday_case_count",
        "week_case_count",
        "month_case_count",
        "drop_percentage_today",
        "avg_case_count_last_4_weeks",
        "drop_percentage_4_weeks",
        "avg_case_count_last_3_weeks",
        "drop_percentage_week",
        "avg_case_count_last_3_months",
        "drop_percentage_month",
    )
