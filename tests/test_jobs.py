"""The jobs over a small set of input tables."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from casepulse import jobs
from casepulse.session import shared_folder
from tests.conftest import rows_of

AS_OF = dt.date(2024, 6, 15)
NOW = dt.datetime(2024, 6, 15, 9)


def back(n, hour=8):
    return dt.datetime.combine(AS_OF - dt.timedelta(days=n), dt.time(hour))


@pytest.fixture(scope="module")
def folders(spark, table, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    inputs, out = f"{root}/in", f"{root}/out"
    studies, number = [], 0
    # Client 1 stopped two days ago, client 2 is active today, client 3 was always small.
    for client, days, per_day in ((1, range(2, 33), 6), (2, range(0, 33), 7), (3, range(2, 33), 1)):
        for n in days:
            for _ in range(per_day):
                number += 1
                studies.append((number, client, back(n), "COMPLETED", '[{"list":["CT"]}]'))
    tables = {
        "studies": studies,
        "study_details": [],
        "clients": [(c, f"c{c}", back(400), False, 0, f"U{c}", f"c{c}@example.org") for c in (1, 2, 3)],
        "client_details": [(1, "web")],
        "client_settings": [(1, False, "postpaid")],
        "client_contacts": [(10, 1, "+91-9876543210", None, "[]", "x"), (11, 1, "NA", "", "[]", "x"), (20, 2, "1", "", "[]", "x"), (30, 3, "9876543211", "", "[]", "x")],
        "client_tat_metrics": [(1, "CT", 500.0)],
        "phase_level_tat": [(1, 500.0)],
        "reworks": [(1, 1, back(1), "COMPLETED", "CLIENT", None)],
    }
    for name, rows in tables.items():
        table(name, rows).write.parquet(f"{inputs}/{name}.parquet")
    jobs.refresh_daily(spark, inputs, out)
    return inputs, out


def test_daily_fact(spark, folders):
    daily = jobs.daily_fact(spark, folders[1])
    assert daily.count() == 31 + 33 + 31
    first = daily.filter("client_fk = 1 AND tat_breach = 1")
    assert rows_of(first, "client_source", "total_case", "Within_TAT") == [("web", 6, 5)]


def run_churn(spark, folders, now):
    inputs, out = folders
    jobs.churn(spark, inputs, out, now, template_id="t", source="910000000000", sender="app")
    return lambda name: spark.read.parquet(f"{out}/{name}")


def test_churn_run_and_its_repetition(spark, folders):
    read = run_churn(spark, folders, NOW)
    assert rows_of(read("client_activity"), "client_fk", "active_days") == [(1, 30), (2, 30), (3, 30)]
    assert rows_of(read("churn_clients"), "client_fk", "churn_category") == [(1, "Critical DAU30 Cat-1 Churn")]
    assert rows_of(read("churn_contacts"), "contact_fk") == [(0,), (10,), (11,)]
    assert rows_of(read("reachable_contacts"), "contact_fk", "Last_30_CT_Count") == [(0, 29 * 6), (10, 29 * 6)]
    first = rows_of(read("created_entries"), "created_id", "contact_fk", "trigger")
    assert [row[0] for row in first] == [1, 2] and {row[1:] for row in first} == {(0, True), (10, True)}
    assert rows_of(read("message_outbox"), "destination") == [("919876543210",)]
    assert read("mail_outbox").count() == 1

    # The same run again, as after a failure: same ids, same decisions, nothing doubled.
    read = run_churn(spark, folders, NOW)
    assert rows_of(read("created_entries"), "created_id", "contact_fk", "trigger") == first
    assert jobs.read_survey_log(spark, f"{folders[1]}/client_survey").count() == 2

    # A later run the same day: within the cool-down.
    read = run_churn(spark, folders, NOW + dt.timedelta(hours=1))
    later = rows_of(read("created_entries"), "created_id", "trigger")
    assert later == [(3, False), (4, False)]
    assert read("to_notify").count() == 0 and read("mail_outbox").count() == 0
    assert not [name for name in os.listdir(shared_folder(spark)) if name.startswith("job-")]


def test_hours_and_days_agree(spark, folders):
    daily, hourly = jobs.daily_fact(spark, folders[1]), jobs.hourly_fact(spark, folders[1])
    columns = ("client_fk", "case_receiving_date", "total_case")
    assert rows_of(hourly, *columns) == rows_of(daily, *columns)


def test_a_day_that_loses_its_cases_leaves_the_facts(spark, table, tmp_path):
    inputs, out = f"{tmp_path}/in", f"{tmp_path}/out"
    names = ("study_details", "client_details", "client_settings", "client_tat_metrics")
    for name in names:
        table(name, []).write.parquet(f"{inputs}/{name}.parquet")
    table("clients", [(1, "c1", back(400), False, 0)]).write.parquet(f"{inputs}/clients.parquet")
    rules = '[{"list":["CT"]}]'
    for status in ("COMPLETED", "OPEN"):
        rows = [(1, 1, back(2), status, rules), (2, 1, back(1), "COMPLETED", rules), (3, 1, back(9), "COMPLETED", rules)]
        table("studies", rows).write.mode("overwrite").parquet(f"{inputs}/studies.parquet")
        jobs.refresh_daily(spark, inputs, out, since=AS_OF - dt.timedelta(days=5 if status == "OPEN" else 9))
    left = [(back(9).date(),), (back(1).date(),)]
    assert rows_of(jobs.daily_fact(spark, out), "case_receiving_date") == left
    assert rows_of(jobs.hourly_fact(spark, out), "case_receiving_date") == left


def test_other_reports(spark, folders):
    inputs, out = folders
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    jobs.silent(spark, inputs, out, AS_OF)
    assert rows_of(read("silent_clients"), "client_fk") == [(1,), (3,)]
    assert rows_of(read("silent_contacts"), "contact_fk") == [(10,), (30,)]
    assert rows_of(read("zero_cases_today"), "client_fk") == [(1,)]
    jobs.trends(spark, out, AS_OF)
    assert rows_of(read("trend_report"), "client_id", "today_case", "yesterday_case_count", "drop_percentage_today") == [(2, 7, 7, 0.0)]
    jobs.comparisons(spark, out, AS_OF)
    assert rows_of(read("steady_client_comparison"), "client_id", "total_cases_today") == [(2, 7)]
    jobs.weekdays(spark, out, AS_OF - dt.timedelta(days=1))
    assert read("same_weekday_drop").count() == 0
    hourly = rows_of(read("same_weekday_hourly"), "client_id", "hour", "case_count", "avg_case_count")
    assert hourly == [(1, 8, 0, 6.0), (2, 8, 7, 7.0), (3, 8, 0, 1.0)]
    assert read("weekday_interval_baseline").count() == 21


def test_command_line(spark, folders, tmp_path, monkeypatch):
    inputs, out = folders
    monkeypatch.setattr(jobs, "get_spark", lambda: spark)
    jobs.main(["trends", "--out", out, "--as-of", "2024-06-15"])
    jobs.main(["trends", "--out", out, "--as-of", "2024-06-15", "--year-aware", "--whole-weeks"])
    jobs.main(["weekdays", "--out", out, "--as-of", "2024-06-15", "--include-silent"])
    assert rows_of(spark.read.parquet(f"{out}/same_weekday_drop"), "client_id", "total_case") == [(1, 0), (3, 0)]
    jobs.main(["comparisons", "--out", out, "--as-of", "2024-06-15", "--cohort-key", "client_id"])
    jobs.main([
        "churn", "--inputs", inputs, "--out", out, "--as-of", "2024-06-15T12:00", "--per-client",
        "--cooldown-on", "triggered", "--only-triggered",
    ])
    assert spark.read.parquet(f"{out}/message_outbox").count() == 0
    with pytest.raises(SystemExit):
        jobs.main(["churn", "--out", out, "--as-of", "2024-06-15"])
    with pytest.raises(SystemExit):
        jobs.main(["trends", "--out", out])


def test_delivery_job(spark, tmp_path):
    spark.createDataFrame([(1, '{"status":"queued"}')], "message_id long, response string").write.parquet(f"{tmp_path}/log")
    jobs.deliveries(spark, f"{tmp_path}/log", str(tmp_path))
    assert rows_of(spark.read.parquet(f"{tmp_path}/delivery_status"), "status_code") == [(202,)]
