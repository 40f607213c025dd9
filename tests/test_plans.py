"""Physical plans that must hold at scale, checked without broadcast joins."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from casepulse.operators import activity, comparison, facts, keyed, sla, survey, trend
from casepulse.plans import bindings, registry
from casepulse.schemas import SCHEMAS

AS_OF = dt.date(2024, 1, 29)


@pytest.fixture(autouse=True)
def shuffled_joins(spark):
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxMetadataStringLength": "5000"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(text, *names):
    return sum(len(re.findall(rf"\b{name}\b", text)) for name in names)


@pytest.fixture(scope="module")
def daily_table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("daily"))
    rows = [(c, f"c{c}", dt.date(2024, 1, 1) + dt.timedelta(days=c % 28), 2) for c in range(50)]
    df = spark.createDataFrame(rows, "client_fk long, client_name string, case_receiving_date date, total_case long")
    df.write.partitionBy("case_receiving_date").mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_churn_is_one_scan_one_shuffle_no_join(daily_table):
    text = plan(activity.churn_tiers(daily_table, as_of=AS_OF))
    assert count(text, "FileScan") == 1
    assert count(text, "Exchange") == 1
    assert "Join" not in text and "SortAggregate" not in text
    assert re.search(r"PartitionFilters: \[.*case_receiving_date.*>=.*2023-12-28", text)


def test_churn_from_raw_events_pushes_the_time_range(spark, testdata):
    text = plan(registry.queries()["churn_tiers"](spark, testdata))
    assert count(text, "Exchange") == 2 and "Join" not in text
    assert "GreaterThanOrEqual(ts,2023-12-28" in text and "LessThan(ts,2024-01-29" in text
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>", text)


def test_text_minimum_is_never_taken_over_the_fact(daily_table, spark):
    text = plan(activity.daily_volume(daily_table, as_of=AS_OF))
    assert count(text, "FileScan") == 1 and count(text, "Exchange") == 2
    # The scan feeds a hash aggregate; only its result is sorted for the smallest name.
    lines = [line for line in text.splitlines() if "Aggregate" in line]
    assert "HashAggregate" in lines[-1] and "HashAggregate" in lines[-2]
    text = plan(trend.trend_report(facts.by_client_id(daily_table), as_of=AS_OF))
    # Only today's slice is sorted.
    sorts = [match.end() for match in re.finditer("SortAggregate", text)]
    assert sorts
    for start in sorts:
        scan = re.search(r"FileScan.*", text[start:]).group()
        assert re.search(r"PartitionFilters: \[[^]]*case_receiving_date#\d+ = 2024-01-29", scan)


def test_rank_filters_cut_each_key_before_the_shuffle(daily_table, spark):
    text = plan(keyed.first_per_key(daily_table, ["client_fk"], [F.col("case_receiving_date")]))
    assert count(text, "WindowGroupLimit") == 2
    exchange, partial = text.index("Exchange"), text.rindex("WindowGroupLimit")
    assert exchange < partial


def test_only_block_sizes_meet_in_one_task(spark):
    entries = spark.createDataFrame(
        [(i, i, "DAU", "t", True) for i in range(10)],
        "contact_fk long, client_fk long, client_active_type string, churn_type string, trigger boolean",
    )
    log = spark.createDataFrame([], SCHEMAS["client_survey"])
    text = plan(survey.with_created_id(entries, log, as_of_ts=dt.datetime(2024, 1, 1)))
    main = text.split("Subquery")[0]
    assert count(text, "SinglePartition") <= 2
    assert not re.search(r"Exchange SinglePartition[^\n]*\n[^\n]*Window", main)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text)


def stored(spark, folder, name, rows):
    schema = SCHEMAS[name]
    full = [tuple(row) + (None,) * (len(schema) - len(row)) for row in rows]
    spark.createDataFrame(full, schema).write.mode("overwrite").parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")


def test_side_tables_are_cut_to_the_wanted_studies_and_shuffled_once(spark, tmp_path):
    ts, rules = dt.datetime(2024, 5, 1), '[{"list":["CT"]}]'
    studies = stored(spark, tmp_path, "studies", [(i, i % 3, ts, "COMPLETED", rules) for i in range(40)])
    details = stored(spark, tmp_path, "study_details", [(i, False) for i in range(40)])
    tat = stored(spark, tmp_path, "client_tat_metrics", [(i, "CT", 50.0) for i in range(40)])
    phase = stored(spark, tmp_path, "phase_level_tat", [(i, 50.0) for i in range(40)])
    reworks = stored(spark, tmp_path, "reworks", [(i, i, ts, "COMPLETED", "CLIENT") for i in range(40)])
    small = [stored(spark, tmp_path, name, []) for name in ("clients", "client_details", "client_settings")]
    reports = (
        facts.daily_client_cases(studies, details, *small, tat),
        sla.modality_sla_summary(studies, reworks, phase, small[0], as_of=dt.date(2024, 5, 2)),
    )
    for report in reports:
        text = plan(report)
        assert count(text, "LeftSemi") == 2
        # Between the scan of a side table and its aggregate there is one shuffle, by study.
        for name in ("tat_min", "is_demo", "overall_tat", "by_user_type"):
            for scan in re.finditer(rf"FileScan parquet \[[^]]*{name}", text):
                above = text[:scan.start()]
                assert "LeftSemi" in above
        assert count(text, r"hashpartitioning\(study_(?:id|fk)#\d+L, [a-z_]+#") == 0


def test_tasks_hold_no_sums_by_study(spark, tmp_path):
    """What a task holds of three tables grows with each sort and each aggregate that its stage has for them."""
    studies = stored(spark, tmp_path, "studies", [(i, i % 3, dt.datetime(2024, 5, 1), "COMPLETED", "") for i in range(9)])
    details = stored(spark, tmp_path, "study_details", [(1, False)])
    tat = stored(spark, tmp_path, "client_tat_metrics", [(1, "CT", 50.0)])
    text = plan(facts.client_case_counts(studies, details, tat, by_hour=True))
    assert not re.search(r"Aggregate\(keys=\[study_", text)
    # The studies once and twice for their ids, both side tables, and one of them once more for equal rows.
    assert count(text, r"Sort \[study_(?:id|fk)") == 6


def test_steady_clients_take_one_pass(daily_table):
    daily = facts.by_client_id(daily_table)
    by_id = plan(comparison.steady_client_comparison(daily, as_of=AS_OF, cohort_key="client_id"))
    assert count(by_id, "FileScan") == 1 and "Join" not in by_id
    by_name = plan(comparison.steady_client_comparison(daily, as_of=AS_OF))
    assert count(by_name, "SortMergeJoin", "ShuffledHashJoin", "BroadcastHashJoin") == 1


def test_silent_clients_and_row_grain_trend_take_few_passes(daily_table):
    text = plan(activity.silent_clients(daily_table, as_of=AS_OF))
    assert count(text, "FileScan") == 1 and "Join" not in text
    text = plan(trend.trend_report(facts.by_client_id(daily_table), as_of=AS_OF, grain="row"))
    assert count(text, "FileScan") == 3 and count(text, "SortMergeJoin") == 2


def test_no_query_uses_python_workers_cross_joins_or_whole_sorts(spark, testdata):
    for name, build in registry.queries().items():
        text = plan(build(spark, testdata))
        assert not re.search(r"CartesianProduct|NestedLoop", text), name
        assert not re.search(r"Python|Pandas|ArrowEval", text), name
        assert "rangepartitioning" not in text, name


def test_scans_read_only_the_columns_they_need(spark, testdata):
    tables = bindings.Tables(spark, testdata)
    text = plan(bindings.dense_daily(tables))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text
