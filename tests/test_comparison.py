from __future__ import annotations

import datetime as dt

import pytest

from casepulse.operators import comparison
from tests.conftest import rows_of

AS_OF = dt.date(2024, 6, 15)


def back(n):
    return AS_OF - dt.timedelta(days=n)


@pytest.fixture(scope="module")
def daily(spark):
    return lambda rows: spark.createDataFrame(
        rows, "client_id long, client_name string, case_receiving_date date, total_case long"
    )


def fact(client, name, offsets, cases=6):
    return [(client, name, back(n), cases) for n in offsets]


def test_cohort_and_changes(daily):
    rows = (
        fact(1, "a", range(3, 27)) + [(1, "a", back(2), 8), (1, "a", back(1), 10), (1, "a", back(0), 7)]
        + fact(2, "b", range(1, 27))  # none today
        + fact(3, "c", range(1, 26))  # 25 days are not enough
        + fact(4, "d", range(0, 26)) + [(4, "d", back(27), 5)]  # one day at the limit
        + fact(5, "e", [0, *range(2, 28)])  # none yesterday
        + fact(6, "f", range(6, 40)) + [(6, "f", back(1), 6)]
        + [(None, "n", back(1), 9), (7, None, back(1), 9)]
    )
    got = comparison.steady_client_comparison(daily(rows), as_of=AS_OF)
    assert rows_of(got) == [
        (1, "a", 7, 10, 8, pytest.approx(-30.0), pytest.approx(25.0), pytest.approx(-12.5)),
        (2, "b", None, 6, 6, None, 0.0, None),
    ]


def test_window_is_thirty_one_days_and_days_add_up(daily):
    rows = fact(1, "a", [30, 31], 2) + fact(1, "a", [30], 3)
    assert rows_of(comparison.daily_cases(daily(rows), as_of=AS_OF), "case_receiving_date", "total_cases") == [(back(30), 5)]
    got = comparison.daily_cases(daily(rows), as_of=AS_OF, window_days=32)
    assert rows_of(got, "total_cases") == [(2,), (5,)]


def test_cohort_by_name_or_by_id(daily):
    # Two clients share a name; one of them dips below the limit.
    rows = fact(1, "same", range(0, 28)) + fact(2, "same", range(0, 28), 5)
    assert rows_of(comparison.steady_client_comparison(daily(rows), as_of=AS_OF), "client_id") == []
    got = comparison.steady_client_comparison(daily(rows), as_of=AS_OF, cohort_key="client_id")
    assert rows_of(got, "client_id") == [(1,)]


def test_a_renamed_client_is_compared_across_its_names(daily):
    rows = fact(1, "old", range(2, 29)) + fact(1, "new", [0, 1], 9) + fact(2, "new", range(2, 29))
    got = comparison.steady_client_comparison(daily(rows), as_of=AS_OF)
    assert rows_of(got, "client_id", "client_name_yesterday", "total_cases_today", "total_cases_yesterday", "total_cases_day_before") == [
        (1, "new", 9, 9, 6)
    ]
