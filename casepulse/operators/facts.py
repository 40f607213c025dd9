"""The daily case fact every report starts from."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casepulse.functions import text
from casepulse.operators.keyed import left_join_defaults, only_keys, without_ids
from casepulse.schemas import DAILY_EXCLUDED, DAILY_SINCE, DAILY_SLA

NO_DATE = dt.date(1970, 1, 1)
DAY_KEYS = ("client_fk", "client_name", "onboarded_date", "case_receiving_date", "client_source")
MEASURES = ("total_case", "Within_TAT", "tat_breach")


def client_day(cases: DataFrame, keys: Sequence[str], ts: str = "created_at") -> DataFrame:
    """One row per key and day with its number of cases, from one row per case."""
    return cases.groupBy(*keys, F.to_date(ts).alias("case_receiving_date")).agg(
        F.count(F.lit(1)).alias("total_case")
    )


def by_client_id(daily: DataFrame) -> DataFrame:
    """The daily fact as the weekday, comparison and trend reports read it."""
    return daily.withColumnRenamed("client_fk", "client_id")


def daily_from_hours(hourly: DataFrame) -> DataFrame:
    """The daily fact, from the hourly one: the same cases, summed over the hours of a day."""
    sums = [F.sum(name).alias(name) for name in MEASURES]
    return hourly.groupBy(*DAY_KEYS).agg(*sums).select(*DAY_KEYS, *MEASURES)


def timed_cases(
    hourly: DataFrame, *, first: dt.date | None = None, last: dt.date | None = None
) -> DataFrame:
    """Cases per client and hour as the hourly reports read them; days as bounds are included."""
    day = F.col("case_receiving_date")
    if first is not None:
        hourly = hourly.filter(day >= F.lit(first))
    if last is not None:
        hourly = hourly.filter(day <= F.lit(last))
    start = day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour"))
    return hourly.select(
        F.col("client_fk").alias("client_id"), "client_name", start.alias("case_receiving_date"), "total_case"
    )


def missing_tat_value(mode: str) -> int | None:
    """The turn-around time of a case without one: 0 and so within target, or left out."""
    return {"zero": 0, "exclude": None}[mode]


def pick_by_modality(values: Mapping[str, Column]) -> Column:
    """The value that belongs to the row's modality, 0 for other modalities."""
    return reduce(
        lambda chain, item: F.when(F.col("modality") == item[0], item[1]).otherwise(chain),
        reversed(values.items()),
        F.lit(0).cast("long"),
    )


def _eligible_clients(
    clients: DataFrame,
    client_details: DataFrame,
    client_settings: DataFrame,
    exclude: Sequence[int] | DataFrame | None,
) -> DataFrame:
    billable = without_ids(clients, "id", exclude).filter(
        ~F.coalesce(F.col("saas_only"), F.lit(False))
    )
    named = billable.select(
        F.col("id").alias("client_fk"),
        "client_name",
        F.to_date("onboarded_at").alias("onboarded_date"),
        "oms_partner",
    )
    sourced = left_join_defaults(
        named, client_details.select("client_fk", "client_source").distinct(), ["client_fk"],
        {"client_source": ""},
    )
    settings = client_settings.select("client_fk", "enable_demo", "billing_type").distinct()
    settled = left_join_defaults(
        sourced, settings, ["client_fk"],
        {"enable_demo": False, "billing_type": ""},
    )
    return (
        settled.filter(F.coalesce(F.col("billing_type"), F.lit("")) != "demo")
        .filter(~F.coalesce(F.col("enable_demo"), F.lit(False)))
        .select("client_fk", "client_name", "onboarded_date", "client_source", "oms_partner")
        .distinct()
    )


REAL_MEASURES = tuple(f"real_{name}" for name in MEASURES)


def client_case_counts(
    studies: DataFrame,
    study_details: DataFrame,
    tat: DataFrame,
    *,
    since: dt.date = DAILY_SINCE,
    sla: Mapping[str, float] = DAILY_SLA,
    missing_tat: str = "zero",
    unescape: str = "double",
    by_hour: bool = False,
) -> DataFrame:
    """The cases of both facts before they meet the clients, summed per client, day and, ``by_hour``, hour.

    Partners do not count the placeholder study 0, so the sums without it (real_) come as well.
    """
    times = ["case_receiving_date", "hour"] if by_hour else ["case_receiving_date"]
    cases = (
        studies.filter(F.col("status") == "COMPLETED")
        .filter(F.to_date("created_at") >= F.lit(since))
        .filter(F.to_date("created_at") != F.lit(NO_DATE))
        .select(
            F.col("id").alias("study_id"),
            "client_fk",
            F.to_date("created_at").alias("case_receiving_date"),
            F.hour("created_at").alias("hour"),
            text.modality(F.col("rules"), unescape).alias("modality"),
        )
    )
    # Both side tables are cut to the wanted studies before they are summed, which leaves them
    # shuffled and sorted by study for all that follows: windows sum them in that order, where hash aggregates
    # would each hold a task's studies in memory and have them sorted again for the next join.
    by_study = Window.partitionBy("study_id")
    # A study stays when it has no detail row or any that is not a demo.
    demo = (
        only_keys(study_details, cases, "study_fk", "study_id")
        .select(F.col("study_fk").alias("study_id"), F.coalesce(F.col("is_demo"), F.lit(False)).alias("is_demo"))
        .select("study_id", F.bool_and("is_demo").over(by_study).alias("only_demo"))
        .filter("only_demo")
        .select("study_id")
    )
    limits = sorted(set(sla.values()))
    # Of equal rows only the first counts, the one whose rank is its number.
    in_order = by_study.orderBy("modality", "tat_min")
    numbered = only_keys(tat.select("study_id", "modality", "tat_min"), cases, "study_id").select(
        "study_id", "tat_min", F.rank().over(in_order).alias("rank"), F.row_number().over(in_order).alias("number"),
    )
    different = F.col("rank") == F.col("number")
    per_study = numbered.select(
        "study_id",
        "number",
        F.count_if(different).over(by_study).alias("tat_rows"),
        *[F.count_if(different & (F.col("tat_min") <= limit)).over(by_study).alias(f"within_{i}") for i, limit in enumerate(limits)],
        *[F.count_if(different & (F.col("tat_min") > limit)).over(by_study).alias(f"breach_{i}") for i, limit in enumerate(limits)],
    ).filter("number = 1").drop("number")
    fill = missing_tat_value(missing_tat)
    defaults = {"tat_rows": 1}
    for i, limit in enumerate(limits):
        defaults[f"within_{i}"] = int(fill is not None and fill <= limit)
        defaults[f"breach_{i}"] = int(fill is not None and fill > limit)
    timed = left_join_defaults(
        cases.join(demo, "study_id", "left_anti"), per_study, ["study_id"], defaults
    )

    measures = {
        "total_case": F.col("tat_rows"),
        "Within_TAT": pick_by_modality({m: F.col(f"within_{limits.index(v)}") for m, v in sla.items()}),
        "tat_breach": pick_by_modality({m: F.col(f"breach_{limits.index(v)}") for m, v in sla.items()}),
    }
    real = F.col("study_id") != 0
    sums = [F.sum(value).alias(name) for name, value in measures.items()]
    real_sums = [
        F.coalesce(F.sum(F.when(real, value)), F.lit(0)).alias(f"real_{name}")
        for name, value in measures.items()
    ]
    return timed.groupBy("client_fk", *times).agg(*sums, *real_sums)


def with_clients(
    counts: DataFrame,
    clients: DataFrame,
    client_details: DataFrame,
    client_settings: DataFrame,
    *,
    exclude: Sequence[int] | DataFrame | None = DAILY_EXCLUDED,
) -> DataFrame:
    """The counts of billable clients with the attributes of the fact."""
    times = [name for name in ("case_receiving_date", "hour") if name in counts.columns]
    dims = _eligible_clients(clients, client_details, client_settings, exclude)
    partner = F.col("oms_partner") == 1
    return (
        counts.join(dims, "client_fk")
        .filter((F.col("oms_partner") == 0) | (partner & (F.col("real_total_case") > 0)))
        .select(
            "client_fk",
            "client_name",
            "onboarded_date",
            *times,
            "client_source",
            *[
                F.when(partner, F.col(f"real_{name}")).otherwise(F.col(name)).alias(name)
                for name in MEASURES
            ],
        )
    )


def _client_cases(
    studies: DataFrame,
    study_details: DataFrame,
    clients: DataFrame,
    client_details: DataFrame,
    client_settings: DataFrame,
    tat: DataFrame,
    *,
    exclude: Sequence[int] | DataFrame | None = DAILY_EXCLUDED,
    **options,
) -> DataFrame:
    counts = client_case_counts(studies, study_details, tat, **options)
    return with_clients(counts, clients, client_details, client_settings, exclude=exclude)


def daily_client_cases(*tables: DataFrame, **options) -> DataFrame:
    """Completed, non-demo cases per client, onboarding day, case day and client source.

    Tables: studies, study_details, clients, client_details, client_settings, client_tat_metrics.
    Options: ``since`` (first day), ``exclude`` (clients), ``sla`` (minutes by modality),
    ``missing_tat``, ``unescape``. ``studies.id`` and ``clients.id`` are primary keys. Different
    (modality, minutes) rows of one study each count as a case, equal ones count once.

    The large tables meet on the study id only; client attributes join after the cases are
    summed per client and day, so a client with a third of all cases never becomes one join
    partition.
    """
    return _client_cases(*tables, **options)


def hourly_client_cases(*tables: DataFrame, **options) -> DataFrame:
    """The daily fact with the hour of the day as one more key: the same cases by the same rules."""
    return _client_cases(*tables, **options, by_hour=True)
