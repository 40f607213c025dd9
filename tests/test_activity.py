from __future__ import annotations

import datetime as dt
import random

import pytest

from casepulse.operators import activity
from casepulse.schemas import CHURN_TIERS, Tier
from tests.conftest import rows_of

AS_OF = dt.date(2024, 6, 15)
SCHEMA = "client_fk long, client_name string, case_receiving_date date, total_case long"


def back(n):
    return AS_OF - dt.timedelta(days=n)


@pytest.fixture(scope="module")
def daily(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def fact(client, offsets, cases=6, name=None):
    return [(client, name or f"c{client}", back(n), cases) for n in offsets]


WINDOW = range(3, 33)


def test_window_bounds_and_mean_over_rows(daily):
    rows = fact(1, [2, 3, 32, 33], 4) + [(1, "c1", back(3), 10), (None, "x", back(5), 1), (2, "c2", back(4), None)]
    got = activity.client_activity(daily(rows), as_of=AS_OF)
    assert rows_of(got) == [(1, 2, 6.0), (2, 1, None)]


@pytest.mark.parametrize(
    "active, last_seen, tier",
    [
        (30, 3, 0), (30, 2, 0), (30, 1, None), (30, 0, 0),
        (29, 4, 1), (29, 3, None), (28, 4, 1), (28, 1, None),
        (27, 6, 2), (25, 6, 2), (25, 5, None), (26, 1, None), (24, 9, None),
    ],
)
def test_tier_edges(daily, active, last_seen, tier):
    """``last_seen`` days ago was the last case; 0 means a case on as_of besides the old ones."""
    older = [n for n in range(32, 2, -1) if n > last_seen]
    offsets = {last_seen, *older[: active - (last_seen in WINDOW)]}
    got = rows_of(activity.churn_tiers(daily(fact(1, offsets)), as_of=AS_OF), "churn_category")
    assert got == ([] if tier is None else [(CHURN_TIERS[tier].churn_category,)])


def test_load_must_exceed_the_limit(daily):
    exact, above = fact(1, WINDOW, 5), fact(2, WINDOW, 5) + [(2, "c2", back(10), 6)]
    assert rows_of(activity.churn_tiers(daily(exact + above), as_of=AS_OF), "client_fk") == [(2,)]


def test_single_pass_equals_three_anti_joins(daily):
    rng = random.Random(3)
    tiers = (Tier(8, 30, 1, "a"), Tier(5, 7, 3, "b"), Tier(2, 4, 5, "c"))
    rows = []
    for client in range(60):
        span = rng.randint(0, 8)
        for n in rng.sample(range(span, 40), rng.randint(1, 25)):
            rows.append((client, f"c{client}", back(n), rng.randint(1, 9)))
    want = []
    for client in range(60):
        mine = [(day, cases) for c, _, day, cases in rows if c == client]
        inside = [(day, cases) for day, cases in mine if back(32) <= day <= back(3)]
        if not inside or sum(c for _, c in inside) / len(inside) <= 3:
            continue
        active = len({day for day, _ in inside})
        for tier in tiers:
            recent = {back(k) for k in range(1, tier.silent_days + 1)}
            if tier.min_days <= active <= tier.max_days and not recent & {day for day, _ in mine}:
                want.append((client, active, tier.churn_category))
    got = activity.churn_tiers(daily(rows), as_of=AS_OF, tiers=tiers, min_avg_load=3)
    assert want and rows_of(got, "client_fk", "active_days", "churn_category") == sorted(want)


def test_overlapping_tiers_are_refused(daily):
    with pytest.raises(ValueError, match="overlap"):
        activity.churn_tiers(daily([]), as_of=AS_OF, tiers=[Tier(1, 5, 1, "a"), Tier(5, 9, 1, "b")])


def test_silent_clients(daily):
    rows = (fact(1, [1]) + fact(2, [0, 1]) + fact(3, [30]) + fact(4, [31]) + fact(5, [0])
            + fact(1, [2], name="renamed") + [(6, None, back(3), 1)])
    got = activity.silent_clients(daily(rows), as_of=AS_OF)
    assert rows_of(got) == [(1, "c1"), (1, "renamed"), (3, "c3"), (6, None)]


def test_silent_contacts_and_directory(spark, daily):
    silent = activity.silent_clients(daily(fact(1, [1]) + fact(2, [1]) + fact(3, [1])), as_of=AS_OF)
    contacts = spark.createDataFrame(
        [(1, 10, "U1", "+91-9876543210"), (1, 11, "U1", None), (1, 12, "U1", ""), (2, 20, "U2", "12"), (9, 90, "U9", "1")],
        "client_fk long, contact_fk long, unique_id string, phone_number string",
    )
    assert rows_of(activity.silent_contacts(silent, contacts)) == [
        (1, "c1", 10, "U1", "919876543210"), (1, "c1", 12, "U1", ""), (2, "c2", 20, "U2", "12"),
    ]
    assert rows_of(activity.silent_directory(silent, contacts), "client_fk", "contact_fk", "phone_number") == [
        (1, 10, "+91-9876543210"), (1, 11, None), (1, 12, ""), (2, 20, "12"), (3, None, None),
    ]


def test_volume_watch(daily):
    full = range(1, 31)
    rows = (
        fact(1, full, 3)  # active every day, none today
        + fact(2, [1, 2], 3)  # none today
        + fact(3, [0], 1) + fact(3, full, 3)  # low today
        + fact(4, [0], 2) + fact(4, full, 3)  # today above half
        + fact(5, full, 2)  # load not above the limit
        + [(6, "b", back(1), 9), (6, "a", back(2), 9), (6, None, back(3), 9), (6, "0", back(0), 3)]
        + [(7, "c7", back(1), 9), (7, "c7", back(0), None)]
    )
    df = daily(rows)
    assert rows_of(activity.zero_cases_today(df, as_of=AS_OF)) == [(1, 30, 3.0, "c1"), (2, 2, 3.0, "c2")]
    assert rows_of(activity.full_activity_no_cases(df, as_of=AS_OF), "client_fk") == [(1,)]
    low = activity.low_activity_today(df, as_of=AS_OF)
    assert rows_of(low, "client_fk", "client_name", "cases_today") == [(3, "c3", 1), (6, "a", 3), (7, "c7", 0)]
    low = activity.low_activity_today(df, as_of=AS_OF, include_silent=True)
    assert rows_of(low, "client_fk") == [(1,), (2,), (3,), (6,), (7,)]


@pytest.mark.parametrize("window", [30, 63, 64, 90, 400])
def test_volume_watch_over_any_window(daily, window):
    rows = [(1, "c1", back(n), 4) for n in range(1, window + 30)]
    rows += [(2, "c2", back(n), 6) for n in range(1, window + 1, 3)] + [(2, "c2", back(0), 1)]
    got = activity.daily_volume(daily(rows), as_of=AS_OF, window_days=window)
    assert rows_of(got, "client_fk", "active_days", "avg_case_load", "cases_today") == [
        (1, window, 4.0, None), (2, len(range(1, window + 1, 3)), 6.0, 1),
    ]
    full = activity.full_activity_no_cases(daily(rows), as_of=AS_OF, window_days=window)
    assert rows_of(full, "client_fk") == [(1,)]
