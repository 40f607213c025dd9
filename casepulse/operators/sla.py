"""Counts per client and modality: cases, cases within target, reworks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casepulse.functions import text
from casepulse.functions.dates import days
from casepulse.functions.numbers import total
from casepulse.operators.facts import missing_tat_value, pick_by_modality
from casepulse.operators.keyed import left_join_defaults, only_keys, without_ids
from casepulse.schemas import MODALITY_EXCLUDED, MODALITY_SLA

# Who may ask for a rework that counts.
REWORK_USERS = ("CLIENT", "ACCOUNT_MANAGER")


def counted_reworks(reworks: DataFrame) -> DataFrame:
    """Completed reworks asked for by the client's side, without a stated reason."""
    return reworks.filter(
        (F.col("status") == "COMPLETED")
        & F.col("by_user_type").isin(*REWORK_USERS)
        & F.col("complete_reason_fk").isNull()
    ).select(
        F.col("id").alias("rework_id"),
        F.col("study_fk").alias("study_id"),
    )


def _month_bounds(as_of: dt.date) -> tuple[dt.date, dt.date]:
    first = as_of.replace(day=1)
    return first, (first + days(31)).replace(day=1) - days(1)


def _studies_with_weights(
    studies: DataFrame,
    reworks: DataFrame | None,
    tat: DataFrame,
    *,
    wanted: Column,
    sla: Mapping[str, float],
    missing_tat: str,
    distinct_studies: bool,
    unescape: str,
) -> DataFrame:
    """One row per study with the number of joined rows it stands for.

    Joining reworks and turn-around rows to a study multiplies them; the counts only need the
    products, so both sides are summed per study first and no pair is ever built. They are cut to
    the wanted studies before that.
    """
    cases = studies.filter(wanted).select(
        F.col("id").alias("study_id"),
        "client_fk",
        F.to_date("created_at").alias("case_date"),
        (F.col("status") == "COMPLETED").alias("completed"),
        text.modality(F.col("rules"), unescape).alias("modality"),
    )
    limits = sorted(set(sla.values()))
    per_study = only_keys(tat, cases, "study_id").groupBy("study_id").agg(
        F.count(F.lit(1)).alias("tat_rows"),
        *[F.count_if(F.col("overall_tat") <= limit).alias(f"within_{i}") for i, limit in enumerate(limits)],
    )
    fill = missing_tat_value(missing_tat)
    defaults = {"tat_rows": 1}
    for i, limit in enumerate(limits):
        defaults[f"within_{i}"] = int(fill is not None and fill <= limit)
    timed = left_join_defaults(cases, per_study, ["study_id"], defaults)
    if reworks is None:
        weighted = timed.withColumns({"rework_rows": F.lit(1), "rework_ids": F.lit(0)})
    else:
        redone = only_keys(counted_reworks(reworks), cases, "study_id").groupBy("study_id").agg(
            F.count(F.lit(1)).alias("rework_rows"),
            F.count_if(F.col("rework_id") != 0).alias("rework_ids"),
        )
        weighted = left_join_defaults(
            timed, redone, ["study_id"], {"rework_rows": 1, "rework_ids": 0}
        )
    within = pick_by_modality({name: F.col(f"within_{limits.index(v)}") for name, v in sla.items()})
    if distinct_studies:
        measures = {
            "case_rows": F.lit(1),
            "within_rows": F.least(within, F.lit(1)),
            "rework_hits": F.col("rework_ids"),
        }
    else:
        measures = {
            "case_rows": F.col("tat_rows") * F.col("rework_rows"),
            "within_rows": within * F.col("rework_rows"),
            "rework_hits": F.col("tat_rows") * F.col("rework_ids"),
        }
    return weighted.withColumns(measures)


def _block_sums(rows: Column, block: str) -> list[Column]:
    """Aggregates of one block, at client and modality grain."""
    return [
        total(F.when(rows, F.col(value))).alias(f"{block}_{value}")
        for value in ("case_rows", "within_rows", "rework_hits")
    ]


def _block_columns(sla: Mapping[str, float], block: str, prefix: str, with_rework: bool) -> list[Column]:
    """The block's sums turned into one column per modality."""
    columns = []
    for name in sla:
        parts = {f"{name}_Count": "case_rows", f"Within_TAT_{name}": "within_rows"}
        if with_rework:
            parts[f"{name}_Rework"] = "rework_hits"
        for label, value in parts.items():
            cell = f"coalesce(sum(if(modality = '{name}', {block}_{value}, 0)), 0)"
            columns.append(F.expr(cell).alias(prefix + label))
    return columns


def modality_sla_summary(
    studies: DataFrame,
    reworks: DataFrame | None,
    tat: DataFrame,
    clients: DataFrame,
    *,
    as_of: dt.date,
    recent_days: int = 30,
    recent: str = "days",
    sla: Mapping[str, float] = MODALITY_SLA,
    exclude: Sequence[int] | DataFrame | None = MODALITY_EXCLUDED,
    missing_tat: str = "zero",
    distinct_studies: bool = False,
    completed_only_recent: bool = False,
    any_status: bool = False,
    unescape: str = "single",
) -> DataFrame:
    """Case, within-target and rework counts per client and modality, overall and recent.

    The overall block takes completed studies of any day; the recent block studies of any
    status from ``as_of - recent_days`` on, or of the calendar month with ``recent='month'``
    (then without rework counts). Only clients with a completed study appear, unless
    ``any_status``: for studies that were cut to part of a client's history.

    One scan of the studies serves both blocks. ``clients.id`` is a primary key and joins after
    the aggregate.
    """
    day = F.to_date("created_at")
    if recent == "month":
        first, last = _month_bounds(as_of)
        prefix, key, is_recent = "Current_", "client_id", day.between(F.lit(first), F.lit(last))
    else:
        first, last = as_of - days(recent_days), None
        prefix, key, is_recent = "Last_30_", "client_fk", day >= F.lit(first)
    done = F.col("status") == "COMPLETED"
    wanted = done if completed_only_recent else done | is_recent

    with_rework = recent != "month"
    weighted = _studies_with_weights(
        without_ids(studies.filter(F.col("client_fk").isNotNull()), "client_fk", exclude),
        reworks if with_rework else None,
        tat,
        wanted=wanted,
        sla=sla,
        missing_tat=missing_tat,
        distinct_studies=distinct_studies,
        unescape=unescape,
    )
    completed = F.coalesce(F.col("completed"), F.lit(False))
    in_recent = F.col("case_date") >= F.lit(first)
    if last is not None:
        in_recent = in_recent & (F.col("case_date") <= F.lit(last))
    if completed_only_recent:
        in_recent = in_recent & completed
    # Few sums per row first; the wide layout is built from one row per client and modality.
    per_modality = weighted.groupBy("client_fk", "modality").agg(
        F.count_if(completed).alias("completed_studies"),
        *_block_sums(completed, "total"),
        *_block_sums(in_recent, "recent"),
    )
    summed = (
        per_modality.groupBy("client_fk")
        .agg(
            F.sum("completed_studies").alias("completed_studies"),
            *_block_columns(sla, "total", "", with_rework),
            *_block_columns(sla, "recent", prefix, with_rework),
        )
        .filter(F.lit(any_status) | (F.col("completed_studies") > 0))
        .drop("completed_studies")
    )
    names = clients.select(F.col("id").alias("client_fk"), "client_name")
    named = left_join_defaults(summed, names, ["client_fk"], {"client_name": ""})
    counts = [c for c in summed.columns if c != "client_fk"]
    return named.select(F.col("client_fk").alias(key), "client_name", *counts)


def modality_sla_month(
    studies: DataFrame, tat: DataFrame, clients: DataFrame, *, as_of: dt.date, **options
) -> DataFrame:
    """The summary with the current calendar month as the recent block, without reworks."""
    return modality_sla_summary(
        studies, None, tat, clients, as_of=as_of, recent="month", **options
    )
