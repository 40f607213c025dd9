from __future__ import annotations

import datetime as dt
import random

import pytest

from casepulse.operators import trend
from tests.conftest import rows_of

SCHEMA = "client_id long, client_name string, case_receiving_date date, total_case long"


@pytest.fixture(scope="module")
def daily(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def sample(seed, as_of, per_day=1):
    rng = random.Random(seed)
    rows = []
    for client in range(1, 9):
        for n in range(0, 430):
            if rng.random() < 0.6:
                for _ in range(rng.randint(1, per_day)):
                    rows.append((client, f"c{client}", as_of - dt.timedelta(days=n), rng.randint(1, 20)))
    return rows


def mean(values):
    values = list(values)
    return pytest.approx(sum(values) / len(values)) if values else None


def grouped(rows, key):
    sums = {}
    for day, cases in rows:
        sums[key(day)] = sums.get(key(day), 0) + cases
    return sums


def brute(rows, client, as_of):
    days = sorted(grouped([(d, n) for c, _, d, n in rows if c == client], lambda d: d).items())
    monday = as_of - dt.timedelta(days=as_of.weekday())
    yesterday = as_of - dt.timedelta(days=1)
    past = [n for d, n in days if d < as_of and d.weekday() == as_of.weekday()][-4:]
    weeks = grouped([x for x in days if as_of - dt.timedelta(days=28) <= x[0] < as_of], lambda d: d.isocalendar().week)
    months = grouped([x for x in days if x[0] < as_of and x[0].month >= as_of.month - 3], lambda d: d.month)
    return {
        "today_case": dict(days).get(as_of),
        "yesterday_case_count": dict(days).get(yesterday),
        "avg_case_count_last_4_weeks": mean(past),
        "week_case_count": sum(n for d, n in days if monday <= d <= as_of),
        "month_case_count": sum(n for d, n in days if d.month == as_of.month),
        "avg_case_count_last_3_weeks": mean(weeks.values()),
        "avg_case_count_last_3_months": mean(months.values()),
    }


@pytest.mark.parametrize("as_of", [dt.date(2024, 6, 11), dt.date(2024, 1, 1), dt.date(2024, 12, 29), dt.date(2025, 1, 3)])
def test_report_against_plain_loops(daily, as_of):
    rows = sample(4, as_of, per_day=2)
    got = {row.client_id: row.asDict() for row in trend.trend_report(daily(rows), as_of=as_of).collect()}
    today = {c for c, _, d, _ in rows if d == as_of}
    assert set(got) == today
    for client in today:
        want = brute(rows, client, as_of)
        assert {name: got[client][name] for name in want} == want


def test_row_and_day_grain_agree_on_a_unique_fact(daily):
    as_of = dt.date(2024, 6, 11)
    df = daily(sample(5, as_of))
    by_day, by_row = trend.trend_report(df, as_of=as_of), trend.trend_report(df, as_of=as_of, grain="row")
    assert by_day.columns == by_row.columns
    assert rows_of(by_day) == rows_of(by_row)


def test_row_grain_multiplies_rows_of_a_day(daily):
    as_of = dt.date(2024, 6, 11)
    rows = [(1, "a", as_of, 2), (1, "a", as_of, 3), (1, "a", as_of - dt.timedelta(days=1), 4), (1, "a", as_of - dt.timedelta(days=1), 5)]
    assert rows_of(trend.trend_report(daily(rows), as_of=as_of), "today_case", "yesterday_case_count") == [(5, 9)]
    got = trend.trend_report(daily(rows), as_of=as_of, grain="row")
    assert rows_of(got, "today_case", "yesterday_case_count") == [(2, 4), (2, 5), (3, 4), (3, 5)]


def test_steps_agree_with_the_report(daily):
    as_of = dt.date(2024, 6, 11)
    df = daily(sample(6, as_of, per_day=2))
    report = trend.trend_report(df, as_of=as_of)
    ids = [row.client_id for row in report.collect()]
    for step in (trend.yesterday_cases, trend.last_same_weekdays, trend.week_to_date, trend.month_cases,
                 trend.last_3_weeks, trend.last_3_months):
        part = step(df, as_of=as_of)
        name = part.columns[1]
        want = {row.client_id: row[name] for row in part.collect()}
        assert {row.client_id: row[name] for row in report.collect()} == {c: want.get(c) for c in ids}


def test_same_month_of_other_years(daily):
    as_of = dt.date(2024, 6, 11)
    rows = [(1, "a", dt.date(2023, 6, 5), 100), (1, "a", dt.date(2024, 6, 5), 1), (1, "a", dt.date(2024, 6, 20), 10)]
    assert rows_of(trend.month_cases(daily(rows), as_of=as_of)) == [(1, 111)]
    assert rows_of(trend.month_cases(daily(rows), as_of=as_of, year_aware=True)) == [(1, 1)]


def test_three_months_in_january(daily):
    as_of = dt.date(2024, 1, 20)
    rows = [(1, "a", dt.date(2023, 5, 1), 8), (1, "a", dt.date(2023, 10, 1), 2), (1, "a", dt.date(2023, 12, 31), 4), (1, "a", dt.date(2024, 1, 2), 6)]
    assert rows_of(trend.last_3_months(daily(rows), as_of=as_of)) == [(1, 5.0)]
    assert rows_of(trend.last_3_months(daily(rows), as_of=as_of, year_aware=True)) == [(1, 3.0)]


def test_three_weeks_whole_or_partial(daily):
    as_of = dt.date(2024, 6, 13)
    days = [as_of - dt.timedelta(days=n) for n in range(0, 40)]
    df = daily([(1, "a", day, 1) for day in days])
    assert rows_of(trend.last_3_weeks(df, as_of=as_of)) == [(1, pytest.approx(28 / 5))]
    assert rows_of(trend.last_3_weeks(df, as_of=as_of, whole_weeks=True)) == [(1, 7.0)]


def test_iso_week_across_new_year(daily):
    as_of = dt.date(2025, 1, 3)
    rows = [(1, "a", dt.date(2024, 12, 30), 3), (1, "a", dt.date(2025, 1, 1), 5), (1, "a", dt.date(2024, 12, 29), 4)]
    assert rows_of(trend.last_3_weeks(daily(rows), as_of=as_of)) == [(1, 6.0)]


def test_zero_baseline_gives_no_percentage(daily):
    as_of = dt.date(2024, 6, 11)
    rows = [(1, "a", as_of, 2), (1, "a", as_of - dt.timedelta(days=1), 0)]
    assert rows_of(trend.trend_report(daily(rows), as_of=as_of), "drop_percentage_today") == [(None,)]
