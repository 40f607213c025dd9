from __future__ import annotations

import datetime as dt
import os

import pytest

from casepulse import session
from casepulse.schemas import SCHEMAS
from casepulse.sources import readers, writers
from tests.conftest import rows_of

NOW = dt.datetime(2024, 11, 13, 9)


def test_conform_orders_casts_and_refuses(spark):
    df = spark.createDataFrame([(True, 5, "x")], "is_demo boolean, study_fk int, extra string")
    got = readers.conform(df, SCHEMAS["study_details"])
    assert got.schema.simpleString() == "struct<study_fk:bigint,is_demo:boolean>"
    with pytest.raises(ValueError, match="is_demo"):
        readers.conform(df.drop("is_demo"), SCHEMAS["study_details"])


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_report_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(2, "b"), (1, None)], "client_fk long, client_source string")
    writers.write_report(df, f"{tmp_path}/client_details.{fmt}", fmt, sort_by=["client_fk"])
    assert rows_of(readers.read_table(spark, str(tmp_path), "client_details", fmt)) == [(1, None), (2, "b")]
    writers.write_report(df.limit(1), f"{tmp_path}/client_details.{fmt}", fmt)
    assert readers.read_table(spark, str(tmp_path), "client_details", fmt).count() == 1


def test_jdbc_options():
    whole = readers.jdbc_options("jdbc:x", query="SELECT 1;\n")
    assert whole["query"] == "SELECT 1" and "dbtable" not in whole
    split = readers.jdbc_options("jdbc:x", query="SELECT 1", partition_column="id", lower=0, upper=9, partitions=3)
    assert split["dbtable"] == "(SELECT 1) AS source" and split["numPartitions"] == "3" and "query" not in split
    assert readers.jdbc_options("jdbc:x", table="t", user="u")["dbtable"] == "t"
    with pytest.raises(ValueError, match="either"):
        readers.jdbc_options("jdbc:x")
    with pytest.raises(ValueError, match="lower"):
        readers.jdbc_options("jdbc:x", table="t", partition_column="id")


def test_fact_replaces_only_the_days_written(spark, tmp_path):
    schema = "client_fk long, case_receiving_date date, total_case long"
    one, two, three = (dt.date(2024, 5, n) for n in (1, 2, 3))
    path = f"{tmp_path}/daily"

    def stored():
        return rows_of(spark.read.parquet(path), "client_fk", "case_receiving_date", "total_case")

    writers.write_by_day(spark.createDataFrame([(1, one, 1), (1, two, 1), (1, three, 1)], schema), path, since=one)
    writers.write_by_day(spark.createDataFrame([(1, two, 5), (2, two, 6)], schema), path)
    assert stored() == [(1, one, 1), (1, two, 5), (1, three, 1), (2, two, 6)]
    # A day in the refreshed range that has lost all its cases leaves nothing behind.
    writers.write_by_day(spark.createDataFrame([(3, three, 9)], schema), path, since=two)
    assert stored() == [(1, one, 1), (3, three, 9)]
    writers.write_by_day(spark.createDataFrame([], schema), path, since=two)
    assert stored() == [(1, one, 1)]


def test_staged_tables_go_with_their_job(spark):
    with writers.staging(spark) as folder:
        assert writers.stage(spark, spark.range(3), "ids").count() == 3
        assert os.listdir(folder)
    assert not os.path.exists(folder)


def created(spark, contacts):
    return spark.createDataFrame(
        [(100 + c, c, 1, "DAU", "t", True, NOW, NOW) for c in contacts],
        "created_id long, contact_fk long, client_fk long, client_active_type string, churn_type string,"
        "trigger boolean, created_at timestamp_ntz, updated_at timestamp_ntz",
    )


def test_survey_log_grows_once_per_entry(spark, tmp_path):
    path = f"{tmp_path}/client_survey"
    assert writers.read_survey_log(spark, path).count() == 0
    staged = writers.append_survey(spark, created(spark, [1, 2]), path, as_of_ts=NOW)
    assert rows_of(staged, "created_id") == [(101,), (102,)]
    writers.append_survey(spark, created(spark, [1, 2, 3]), path, as_of_ts=NOW)
    assert rows_of(writers.read_survey_log(spark, path), "id", "contact_fk") == [(101, 1), (102, 2), (103, 3)]
    assert writers.read_survey_log(spark, path, since=NOW.date()).count() == 3
    assert writers.read_survey_log(spark, path, since=NOW.date() + dt.timedelta(days=1)).count() == 0
    assert sorted(name for name in os.listdir(path) if "=" in name) == ["created_date=2024-11-13"]


def test_staged_rows_do_not_follow_their_source(spark, tmp_path):
    path = f"{tmp_path}/source"
    spark.range(3).write.parquet(path)
    staged = writers.stage(spark, spark.read.parquet(path), "ids")
    spark.range(5).write.mode("append").parquet(path)
    assert staged.count() == 3
    assert staged.inputFiles()[0].startswith("file://" + session.shared_folder(spark))


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
