from __future__ import annotations

import datetime as dt
import random

import pytest
from casepulse.operators import facts
from tests.conftest import rows_of

LIMITS = {"XRAY": 60, "CT": 120, "MRI": 180}


def at(day, hour=10):
    return dt.datetime(2024, 5, day, hour)


def rules(name):
    return f'[{{"list":["{name}","X"]}}]'


@pytest.fixture(scope="module")
def make(table):
    """Runs the fact over small tables; every table has a usable default."""

    def run(studies, details=(), clients=((1, "one", at(1), False, 0),), sources=(), settings=(), tat=(), **options):
        options.setdefault("exclude", None)
        return facts.daily_client_cases(
            table("studies", studies), table("study_details", details), table("clients", clients),
            table("client_details", sources), table("client_settings", settings),
            table("client_tat_metrics", tat), **options,
        )

    return run


COUNTS = ("client_fk", "client_source", "total_case", "Within_TAT", "tat_breach")


def test_only_completed_real_studies_since_the_first_day(make):
    studies = [
        (1, 1, at(1), "COMPLETED", rules("CT")),
        (2, 1, at(1), "OPEN", rules("CT")),
        (3, 1, dt.datetime(2024, 3, 31, 23), "COMPLETED", rules("CT")),
        (4, 1, at(1), "COMPLETED", rules("CT")),
        (5, 1, at(1), "COMPLETED", rules("CT")),
        (6, 1, at(1), "COMPLETED", rules("CT")),
    ]
    details = [(4, True), (5, False), (6, None)]
    got = make(studies, details)
    # 1 has no detail row, 5 is no demo, 6 does not say.
    assert rows_of(got, "total_case") == [(3,)]


def test_a_study_with_a_demo_and_a_real_detail_counts_once(make):
    got = make([(1, 1, at(1), "COMPLETED", rules("CT"))], [(1, True), (1, False), (1, None)])
    assert rows_of(got, "total_case") == [(1,)]


def test_missing_turn_around_time_counts_as_within_unless_excluded(make):
    studies = [(1, 1, at(1), "COMPLETED", rules("XRAY")), (2, 1, at(1), "COMPLETED", rules("NM"))]
    assert rows_of(make(studies), *COUNTS) == [(1, "", 2, 1, 0)]
    assert rows_of(make(studies, missing_tat="exclude"), *COUNTS) == [(1, "", 2, 0, 0)]


def test_limits_are_inclusive_and_null_minutes_count_nowhere(make):
    studies = [(i, 1, at(1), "COMPLETED", rules("XRAY")) for i in (1, 2, 3)]
    tat = [(1, "XRAY", 60.0), (2, "XRAY", 60.5), (3, "XRAY", None)]
    assert rows_of(make(studies, tat=tat), *COUNTS) == [(1, "", 3, 1, 1)]


def test_different_turn_around_rows_multiply_a_case_and_equal_ones_do_not(make):
    studies = [(1, 1, at(1), "COMPLETED", rules("CT"))]
    tat = [(1, "CT", 100.0), (1, "CT", 100.0), (1, "CTA", 100.0), (1, "CT", 130.0)]
    assert rows_of(make(studies, tat=tat), *COUNTS) == [(1, "", 3, 2, 1)]


def test_missing_and_odd_minutes_are_equal_to_themselves(make):
    studies = [(i, 1, at(1), "COMPLETED", rules("CT")) for i in (1, 2, 2, None)]
    nan = float("nan")
    tat = [(1, None, None), (1, None, None), (1, "CT", nan), (1, "CT", nan), (1, "CT", 0.0), (1, "CT", -0.0),
           (None, "CT", 1.0), (2, "CT", None), (2, None, None), (2, "CT", 7.0), (2, "CT", 7.0), (9, "CT", 1.0)]
    # Study 1 has three different rows, each of two rows with id 2 as well; a study without an id has none.
    assert rows_of(make(studies, [(None, True), (9, True)], tat=tat), *COUNTS) == [(1, "", 3 + 2 * 3 + 1, 1 + 2 + 1, 1)]


def test_client_rules(make):
    studies = [(i, i, at(1), "COMPLETED", rules("CT")) for i in range(1, 10)]
    clients = [
        (1, "kept", at(1), False, 0),
        (2, "saas", at(1), True, 0),
        (3, "unknown saas", at(1), None, 0),
        (4, "demo billing", at(1), False, 0),
        (5, "demo enabled", at(1), False, 0),
        (6, "excluded", at(1), False, 0),
        (7, "partner", at(1), False, 1),
        (8, "other partner kind", at(1), False, 2),
        (9, "no settings", None, False, 0),
        (10, "no studies", at(1), False, 0),
    ]
    settings = [(i, i == 5, "demo" if i == 4 else None if i == 3 else "postpaid") for i in range(1, 9)]
    got = make(studies, clients=clients, settings=settings, exclude=[6])
    assert rows_of(got, "client_name") == [
        ("kept",), ("no settings",), ("partner",), ("unknown saas",),
    ]


def test_study_zero_is_a_placeholder_for_partners_only(make):
    studies = [(0, 1, at(1), "COMPLETED", rules("CT")), (0, 2, at(1), "COMPLETED", rules("CT")),
               (5, 2, at(1), "COMPLETED", rules("CT")), (0, 3, at(2), "COMPLETED", rules("CT"))]
    clients = [(1, "plain", at(1), False, 0), (2, "partner", at(1), False, 1), (3, "empty", at(1), False, 1)]
    got = make(studies, clients=clients)
    assert rows_of(got, "client_name", "total_case") == [("partner", 1), ("plain", 1)]


def test_two_client_sources_give_two_rows(make):
    got = make([(1, 1, at(1), "COMPLETED", rules("CT"))], sources=[(1, "a"), (1, "b"), (1, "b")])
    assert rows_of(got, "client_source", "total_case") == [("a", 1), ("b", 1)]


def test_against_row_by_row_joins(make):
    rng = random.Random(7)
    names = ["XRAY", "CT", "MRI", "NM"]
    studies = [
        (i, rng.choice([1, 1, 1, 2, 3]), at(rng.randint(1, 4)), rng.choice(["COMPLETED"] * 3 + ["OPEN"]),
         rules(rng.choice(names)))
        for i in range(1, 200)
    ]
    tat = [(rng.randint(1, 200), rng.choice(names), float(rng.choice([30, 60, 90, 150, 200]))) for _ in range(300)]
    clients = [(1, "one", at(1), False, 0), (2, "two", at(2), False, 1), (3, "three", at(3), True, 0)]
    sources = [(1, "a"), (1, "b")]
    seen = set()
    for study, client, ts, status, rule in studies:
        if status != "COMPLETED" or client == 3:
            continue
        name = rule.split('"')[3]
        times = {(m, v) for s, m, v in tat if s == study} or {("", 0.0)}
        for source in [s for c, s in sources if c == client] or [""]:
            for kind, minutes in times:
                seen.add((client, ts.date(), source, study, name, kind, minutes))
    want = {}
    for client, day, source, _, name, _, minutes in seen:
        cell = want.setdefault((client, day, source), [0, 0, 0])
        cell[0] += 1
        if name in LIMITS:
            cell[1 if minutes <= LIMITS[name] else 2] += 1
    got = make(studies, clients=clients, sources=sources, tat=tat)
    assert rows_of(got, "client_fk", "case_receiving_date", "client_source", "total_case", "Within_TAT", "tat_breach") == sorted(
        (*key, *cell) for key, cell in want.items()
    )


def test_client_day_counts_rows(spark):
    cases = spark.createDataFrame([(1, at(1, 0)), (1, at(1, 23)), (1, at(2)), (2, at(1))], "client_fk long, created_at timestamp_ntz")
    assert rows_of(facts.client_day(cases, ["client_fk"]), "client_fk", "total_case") == [(1, 1), (1, 2), (2, 1)]


def test_hours_follow_the_rules_of_the_days(table):
    """Demo, excluded, software-only and partner clients: both facts keep the same cases."""
    rules = '[{"list":["CT"]}]'
    studies = table("studies", [
        (1, 1, at(1, 7), "COMPLETED", rules), (2, 1, at(1, 9), "OPEN", rules),
        (3, 1, at(1, 7) + dt.timedelta(minutes=59), "COMPLETED", rules), (4, 1, at(3, 0), "COMPLETED", rules),
        (5, 2, at(1, 7), "COMPLETED", rules), (6, 3, at(1, 7), "COMPLETED", rules),
        (7, 4, at(1, 7), "COMPLETED", rules), (0, 5, at(1, 7), "COMPLETED", rules), (8, 5, at(1, 8), "COMPLETED", rules),
        (9, 9, at(1, 7), "COMPLETED", rules),
    ])
    clients = table("clients", [
        (1, "one", at(1), False, 0), (2, "demo", at(1), False, 0), (3, "excluded", at(1), False, 0),
        (4, "software", at(1), True, 0), (5, "partner", at(1), False, 1),
    ])
    tables = (
        studies, table("study_details", []), clients, table("client_details", []),
        table("client_settings", [(2, True, "postpaid")]), table("client_tat_metrics", [(3, "CT", 500.0), (3, "CT", 1.0)]),
    )
    options = {"since": dt.date(2024, 1, 1), "exclude": [3]}
    hourly = facts.hourly_client_cases(*tables, **options)
    daily = facts.daily_client_cases(*tables, **options)
    assert rows_of(facts.daily_from_hours(hourly), *daily.columns) == rows_of(daily)
    timed = facts.timed_cases(hourly)
    columns = ("client_id", "client_name", "case_receiving_date", "total_case")
    assert timed.schema["case_receiving_date"].dataType.simpleString() == "timestamp_ntz"
    assert rows_of(timed, *columns) == [
        (1, "one", at(1, 7), 3), (1, "one", at(3, 0), 1), (5, "partner", at(1, 8), 1),
    ]
    bounded = facts.timed_cases(hourly, first=dt.date(2024, 5, 2), last=dt.date(2024, 5, 3))
    assert rows_of(bounded, *columns) == [(1, "one", at(3, 0), 1)]
    assert rows_of(facts.timed_cases(hourly, last=dt.date(2024, 5, 2)), "total_case") == [(1,), (3,)]


def test_client_key_rename(spark):
    assert facts.by_client_id(spark.range(1).withColumnRenamed("id", "client_fk")).columns == ["client_id"]
