"""Reports, the daily fact and the survey log on shared storage."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casepulse.operators.survey import new_entries
from casepulse.schemas import SCHEMAS
from casepulse.session import shared_folder
from casepulse.sources.readers import conform


def write_report(
    df: DataFrame, path: str, fmt: str = "parquet", sort_by: Sequence[str] = ()
) -> None:
    """A report as a folder of files, without an index column; sorted across files on request."""
    if sort_by:
        df = df.sort(*sort_by)
    df.write.mode("overwrite").format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(path)


def write_by_day(
    fact: DataFrame, path: str, *, since: dt.date | None = None, days: Iterable[dt.date] | None = None,
    staged: bool = False,
) -> None:
    """A fact, one folder per case day; days of the input replace what is stored of them.

    With ``since`` the input is all there is from then on: a stored day from ``since`` that is not
    in it lost its last case, and its folder goes; with ``days`` so for each of these. The rebalance gives each day few files and
    splits a day that is too large for one. The input is staged, as its days are read as well, unless it is
    ``staged``: read from files that are not below ``path``.
    """
    day, spark = "case_receiving_date", fact.sparkSession
    held = fact if staged else stage(spark, fact, "fact")
    held.hint("rebalance", day).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(day).parquet(path)
    if since is not None:
        stored = spark.read.schema(fact.schema).parquet(path).filter(F.col(day) >= F.lit(since))
        gone = stored.select(day).distinct().join(held.select(day).distinct(), day, "left_anti")
        for row in gone.collect():  # days, not rows of the fact
            remove_folder(spark, f"{path}/{day}={row[0].isoformat()}")
    if days is not None:
        left = {row[0] for row in held.select(day).distinct().collect()}
        for gone in set(days) - left:
            remove_folder(spark, f"{path}/{day}={gone.isoformat()}")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever the path points, as Spark's writers do when they overwrite."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """Tables staged inside go to one folder, which is removed at the end."""
    path = f"{shared_folder(spark)}/job-{uuid.uuid4().hex}"
    token = _FOLDER.set(path)
    try:
        yield path
    finally:
        _FOLDER.reset(token)
        remove_folder(spark, path)


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write to a new folder on shared storage and read back.

    Cuts the lineage: what is read twice is computed once, stays the same whatever happens to
    its sources, and survives the loss of executors. Outside ``staging`` the folder stays, as the
    frame may be read at any time.
    """
    path = f"{_FOLDER.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_survey_log(spark: SparkSession, path: str, since: dt.date | None = None) -> DataFrame:
    """The survey log, or its entries from a day on; empty before its first entry."""
    schema = SCHEMAS["client_survey"]
    try:
        log = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if since is not None:
        log = log.filter(F.col("created_date") >= F.lit(since))
    return conform(log, schema)


def append_survey(
    spark: SparkSession, created: DataFrame, log_path: str, *, as_of_ts: dt.datetime
) -> DataFrame:
    """Append created entries to the log and return them.

    The entries depend on the log, so they are staged first: read again after the append they
    would see themselves. A repeated run with the same as-of time appends nothing twice.
    """
    staged = stage(spark, created, "survey")
    today = read_survey_log(spark, log_path, since=as_of_ts.date())
    fresh = new_entries(staged, today, as_of_ts=as_of_ts).withColumn(
        "created_date", F.to_date("created_at")
    )
    fresh.write.mode("append").partitionBy("created_date").parquet(log_path)
    return staged
