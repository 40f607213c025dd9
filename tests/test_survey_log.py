"""Atomic appends, ids and snapshots of the survey log."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from casepulse.operators import survey
from casepulse.sources import commits, writers
from casepulse.sources.survey_log import SurveyLog, read_survey_log
from tests.conftest import rows_of

NOW = dt.datetime(2024, 6, 15, 9)
HOUR = dt.timedelta(hours=1)
REACH = dt.timedelta(days=7)


@pytest.fixture
def log(spark, tmp_path):
    return SurveyLog(spark, f"{tmp_path}/client_survey")


@pytest.fixture
def reachable(spark):
    def build(contacts):
        return spark.createDataFrame(
            [(c, 1, "DAU", "Tier") for c in contacts], "contact_fk long, client_fk long, client_active_type string, churn_type string"
        )

    return build


def run(log, reachable, contacts, now, meanwhile=lambda: None):
    """A run's append; ``meanwhile`` happens after the run has read the log."""
    def decide(recent):
        entries = survey.survey_entries(reachable(contacts), recent, as_of_ts=now, tier_order=["Tier"])
        entries = writers.stage(log.spark, entries, "decided")
        meanwhile()
        return entries

    return log.append(decide, as_of_ts=now, reach=REACH)


def test_two_runs_at_once_take_different_ids_and_see_each_other(log, reachable):
    others = [lambda: run(log, reachable, [2, 3, 4], NOW - HOUR)]
    created = run(log, reachable, [1, 2, 3], NOW, meanwhile=lambda: others and others.pop()())
    assert rows_of(log.read(), "id") == [(k,) for k in range(1, 7)]
    # The run that lost its number has decided again: contacts of the other run are in their cool-down.
    assert rows_of(created, "contact_fk", "trigger") == [(1, True), (2, False), (3, False)]
    assert rows_of(created, "created_id") == [(4,), (5,), (6,)]
    assert len(os.listdir(f"{log.path}/data")) == 2


def test_a_killed_run_leaves_nothing_visible(log, reachable, monkeypatch):
    run(log, reachable, [1], NOW)

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(commits.Commits, "create", killed)
    with pytest.raises(KeyboardInterrupt):
        run(log, reachable, [2], NOW + HOUR)
    monkeypatch.undo()
    assert rows_of(log.read(), "id", "contact_fk") == [(1, 1)] and len(os.listdir(f"{log.path}/data")) == 2
    assert rows_of(run(log, reachable, [2], NOW + HOUR), "created_id") == [(2,)]


def test_a_repeated_run_appends_nothing(log, reachable):
    first = rows_of(run(log, reachable, [1, 2], NOW))
    again = run(log, reachable, [1, 2, 3], NOW)
    assert rows_of(again.filter("contact_fk < 3")) == first and rows_of(again, "created_id") == [(1,), (2,), (3,)]
    version = log.head()["number"]
    run(log, reachable, [1, 2, 3], NOW)
    assert log.head()["number"] == version and log.read().count() == 3


def test_a_number_is_taken_once(spark, tmp_path):
    made = commits.Commits(spark, f"{tmp_path}/commits")
    assert made.last() is None and made.create(1, {"a": 1}) and not made.create(1, {"a": 2})
    assert made.last() == {"a": 1, "number": 1} and made.numbers() == [1]
    assert [name for name in os.listdir(f"{tmp_path}/commits") if name.endswith(".tmp")] == []


def test_a_plain_log_goes_on(spark, log, reachable, table):
    old = [(7, 1, 1, "DAU", "Tier", None, True, NOW - dt.timedelta(days=3), NOW), (5, 9, 1, "DAU", "Tier", None, True, NOW - dt.timedelta(days=30), NOW)]
    table("client_survey", old).selectExpr("*", "to_date(created_at) AS created_date").write.partitionBy("created_date").parquet(log.path)
    created = run(log, reachable, [1, 2], NOW)
    assert rows_of(created, "created_id", "contact_fk", "trigger") == [(8, 1, False), (9, 2, True)]
    assert rows_of(read_survey_log(spark, log.path), "id") == [(5,), (7,), (8,), (9,)]
    assert rows_of(log.read(since=NOW.date()), "id") == [(8,), (9,)]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_snapshot_replaces_the_scan_of_the_log(spark, log, reachable):
    assert log.last_entries().count() == 0
    log.compact()
    for k, contacts in enumerate(([1, 2], [2, 3])):
        run(log, reachable, contacts, NOW + k * HOUR)
    whole = rows_of(log.last_entries())
    log.compact()
    assert rows_of(log.last_entries()) == whole == [(1, NOW), (2, NOW + HOUR), (3, NOW + HOUR)]
    assert "client_survey/data" not in plan(log.last_entries())
    run(log, reachable, [3, 4], NOW + 2 * HOUR)
    head = log.head()
    assert rows_of(log.last_entries()) == [(1, NOW), (2, NOW + HOUR), (3, NOW + 2 * HOUR), (4, NOW + 2 * HOUR)]
    read = {name.split("client_survey/")[1].split("/part")[0] for name in log.last_entries().inputFiles()}
    assert read == {head["snapshot"]["folder"], head["parts"][-1]["folder"]}
    log.compact()
    assert log.last_entries().count() == 4 and log.head()["last_id"] == 6


def test_ids_come_from_the_manifest(log, reachable):
    run(log, reachable, [1, 2], NOW - dt.timedelta(days=40))
    old = log.head()["parts"][0]["folder"]
    created = run(log, reachable, [1], NOW)
    assert rows_of(created, "created_id", "trigger") == [(3, True)]
    # What the second run read of the log did not include the first run's folder.
    assert log.read(since=(NOW - REACH).date()).inputFiles() and old not in "".join(log.read(since=(NOW - REACH).date()).inputFiles())
