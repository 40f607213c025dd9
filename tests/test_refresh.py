"""Facts, running means and rings after changes, against full runs."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casepulse import jobs, refresh
from casepulse.functions.dates import day_ranges, days, on_days
from casepulse.operators import activity, digests, facts, rolling, weekday
from casepulse.schemas import CHURN_TIERS, SCHEMAS
from casepulse.sources import writers
from tests.conftest import rows_of

FIRST = dt.date(2024, 6, 1)
RULES = '[{"list":["CT"]}]'


def at(n, hour=8):
    return dt.datetime.combine(FIRST + days(n), dt.time(hour))


@pytest.fixture
def tables(table, tmp_path):
    """Input tables that a test may change and write again."""
    made = {
        "studies": [(k, k % 3 + 1, at(k % 12, k % 24), "COMPLETED", RULES) for k in range(1, 90)],
        "study_details": [(5, True), (7, False)],
        "clients": [(c, f"c{c}", at(-300), False, 0, f"U{c}", None) for c in (1, 2, 3)],
        "client_details": [(1, "web")], "client_settings": [(2, False, "postpaid")],
        "client_tat_metrics": [(k, "CT", 60.0 + k) for k in range(1, 90, 2)],
    }

    def write():
        for name, rows in made.items():
            table(name, rows).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in/{name}.parquet")
        return f"{tmp_path}/in"

    return made, write


def agree(spark, inputs, out, full):
    """Both facts, the totals and the rings are those of a run over all days."""
    jobs.refresh_daily(spark, inputs, full, since=FIRST)
    state, daily, hours = refresh.State(spark, out), jobs.daily_fact(spark, full), jobs.hourly_fact(spark, full)
    assert rows_of(jobs.daily_fact(spark, out)) == rows_of(daily)
    assert rows_of(jobs.hourly_fact(spark, out)) == rows_of(hours)
    assert rows_of(state.totals()) == rows_of(weekday.interval_totals(facts.timed_cases(hours)))
    assert rows_of(state.ring()) == rows_of(rolling.window_state(daily, through=state.through))


def test_only_changed_days_are_rebuilt(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(digests, "BLOCK", 8)
    made, write = tables
    out, full = f"{tmp_path}/out", f"{tmp_path}/full"
    assert refresh.refresh_changed(spark, write(), out, FIRST) == [FIRST + days(n) for n in range(12)]
    assert refresh.refresh_changed(spark, write(), out, FIRST) == []
    # A late status change, a study that moves to a new day, and a new day.
    made["studies"] = [(i, c, at(14) if i == 30 else t, "OPEN" if i == 16 else s, r) for i, c, t, s, r in made["studies"]]
    assert refresh.refresh_changed(spark, write(), out, FIRST) == [FIRST + days(n) for n in (4, 6, 14)]
    agree(spark, write(), out, full)
    # Details of one study touch the days of its block of ids; study 40 alone is on day 4.
    made["study_details"].append((40, True))
    assert FIRST + days(4) in refresh.refresh_changed(spark, write(), out, FIRST)
    # A client that is no longer billed leaves all days without a read of the raw tables.
    made["clients"][1] = (2, "c2", at(-300), True, 0, "U2", None)
    made["clients"][2] = (3, "renamed", at(-300), False, 0, "U3", None)
    refresh.refresh_changed(spark, write(), out, FIRST)
    agree(spark, write(), out, full)


def test_a_refresh_that_was_killed_is_ended_by_the_next(spark, tables, tmp_path, monkeypatch):
    made, write = tables
    out = f"{tmp_path}/out"
    refresh.refresh_changed(spark, write(), out, FIRST)
    made["studies"] = [(i, c, t, "OPEN" if i < 10 else s, r) for i, c, t, s, r in made["studies"]]
    written = refresh.write_by_day

    def killed(df, path, **options):
        if path.endswith(refresh.HOURLY):
            raise KeyboardInterrupt
        written(df, path, **options)

    monkeypatch.setattr(refresh, "write_by_day", killed)
    with pytest.raises(KeyboardInterrupt):
        refresh.refresh_changed(spark, write(), out, FIRST)
    monkeypatch.undo()
    assert refresh.State(spark, out).content["kind"] == "prepared"
    assert refresh.refresh_changed(spark, write(), out, FIRST) == []
    agree(spark, write(), out, f"{tmp_path}/full")


def test_stored_days_are_not_written_on_the_way(spark, tables, tmp_path, monkeypatch):
    made, write = tables
    out, staged = f"{tmp_path}/out", []
    jobs.refresh_daily(spark, write(), out, since=FIRST)
    # Another writer left day 3, which has no cases any more; the first refresh dies before it takes it away.
    made["studies"] = [row for row in made["studies"] if row[2].date() != FIRST + days(3)]
    for module in (writers, refresh):
        monkeypatch.setattr(module, "stage", lambda s, df, name, of=writers.stage: staged.append(name) or of(s, df, name))
    finish = refresh.State.finish
    monkeypatch.setattr(refresh.State, "finish", lambda state: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        refresh.refresh_changed(spark, write(), out, FIRST)
    monkeypatch.setattr(refresh.State, "finish", finish)
    assert refresh.refresh_changed(spark, write(), out, FIRST) == []
    assert set(staged) <= {"who"}
    agree(spark, write(), out, f"{tmp_path}/full")


def test_the_scan_is_cut_to_the_changed_days(spark, tables):
    _, write = tables
    studies = spark.read.schema(SCHEMAS["studies"]).parquet(f"{write()}/studies.parquet")
    plan = studies.filter(on_days("created_at", [FIRST, FIRST + days(1), FIRST + days(5)], time=True))._jdf.queryExecution().toString()
    pushed = plan.split("PushedFilters:")[1].split("]")[0]
    assert "Or(And(GreaterThanOrEqual(created_at,2024-06-01T00:00),LessThan(created_at,2024-06-03T00:00))" in pushed


def test_day_ranges():
    assert day_ranges([FIRST + days(n) for n in (3, 1, 2, 7, 1)]) == [(FIRST + days(1), FIRST + days(3)), (FIRST + days(7),) * 2]


def test_digests_do_not_depend_on_order_and_add_up(spark):
    rows = [(k % 4, k, None if k % 5 else "x") for k in range(100)]
    part = lambda rows: digests.digest(spark.createDataFrame(rows, "p long, a long, b string"), [F.col("p")], ["a", "b"])
    whole, again = part(rows), part(rows[::-1])
    assert rows_of(whole) == rows_of(again)
    summed = part(rows[:30]).unionByName(part(rows[30:])).groupBy("p").agg(*(F.sum(c).alias(c) for c in digests.SUMS))
    assert rows_of(summed) == rows_of(whole)
    other = part([(p, a, "y" if a == 42 else b) for p, a, b in rows if a != 7] + [(9, None, None)])
    assert rows_of(digests.changed(other, whole, ["p"])) == [(2,), (3,), (9,)]
    assert digests.changed(whole, part(rows + rows[:1]), ["p"]).count() == 1


def test_rings_give_the_reports_of_the_fact(spark):
    rng = random.Random(5)
    rows = [(c, "n", FIRST + days(n), rng.choice([None, 0, 3, 9, 40])) for c in (1, 2, 3, 4, None) for n in range(70) if rng.random() < 0.4 + 0.15 * (c or 0)]
    rows += [(c, "other name", day, cases) for c, _, day, cases in rows[:40]]
    daily = spark.createDataFrame(rows, "client_fk long, client_name string, case_receiving_date date, total_case long")
    through = FIRST + days(50)
    changed = [FIRST + days(n) for n in (20, 41)]
    old = daily.filter(daily.case_receiving_date <= through).filter(~daily.case_receiving_date.isin(changed[:1]))
    state = rolling.window_state(old, through=through, size=50)
    for n in (55, 56, 69):
        state = rolling.advanced(state, daily, through=through, to=FIRST + days(n), replaced=changed, size=50)
        through = FIRST + days(n)
        for as_of in (through - days(2), through + days(1), through + days(4)):
            options = {"as_of": as_of, "window_days": 30}
            want = activity.client_activity(daily.filter(daily.case_receiving_date <= through), **options)
            assert rows_of(rolling.client_activity(state, through=through, size=50, **options)) == rows_of(want)
            tiers = [t._replace(min_days=lo, max_days=hi) for t, lo, hi in zip(CHURN_TIERS, (20, 12, 1), (30, 19, 11), strict=True)]
            want = activity.churn_tiers(daily.filter(daily.case_receiving_date <= through), tiers=tiers, min_avg_load=1, **options)
            assert rows_of(rolling.churn_tiers(state, through=through, size=50, tiers=tiers, min_avg_load=1, **options)) == rows_of(want)
    with pytest.raises(ValueError, match="before"):
        rolling.client_activity(state, through=through, as_of=through - days(40), size=50)
    with pytest.raises(ValueError, match="already"):
        rolling.advanced(state, daily, through=through, to=through - days(1), size=50)
