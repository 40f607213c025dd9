"""The reports as jobs: input tables below one folder, results below another.

    python -m casepulse.jobs daily --inputs IN --out OUT
    python -m casepulse.jobs churn --inputs IN --out OUT --as-of 2024-11-13

``daily`` writes the hourly and the daily fact, which the other jobs read; ``refresh`` brings them up to
date by the days that have changed, and keeps windows and means for the other jobs. Tables that a job stages
are gone when it ends.
"""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casepulse.functions.dates import days, same_weekday_dates
from casepulse.operators import (
    activity,
    comparison,
    contacts,
    facts,
    outbox,
    rolling,
    sla,
    survey,
    trend,
    weekday,
)
from casepulse.refresh import State, refresh_changed
from casepulse.schemas import CHURN_TIERS, DAILY_SINCE, SCHEMAS, Tier
from casepulse.session import get_spark
from casepulse.sources.readers import conform, read_table
from casepulse.sources.survey_log import SurveyLog, read_survey_log
from casepulse.sources.writers import (
    stage,
    staging,
    write_by_day,
    write_report,
)

DAILY, HOURLY = "daily_client_cases", "hourly_client_cases"

# The activity window of the churn report, and how long before the run it ends.
LAG_DAYS, WINDOW_DAYS = 3, 30


def job(run: Callable[..., None]) -> Callable[..., None]:
    """A job whose staged tables go when it ends."""

    @wraps(run)
    def inside(spark: SparkSession, *arguments, **options) -> None:
        with staging(spark):
            run(spark, *arguments, **options)

    return inside


@job
def refresh_daily(spark: SparkSession, inputs: str, out: str, since: dt.date = DAILY_SINCE) -> None:
    """Hourly and daily fact of the cases from ``since`` on; earlier days stay as they are.

    The raw tables are read once, for the hours; the days are summed from what was stored.
    ``refresh.refresh_changed`` gives the same facts and reads the changed days only.
    """
    names = (
        "studies", "study_details", "clients", "client_details", "client_settings",
        "client_tat_metrics",
    )
    tables = [read_table(spark, inputs, name) for name in names]
    write_by_day(facts.hourly_client_cases(*tables, since=since), f"{out}/{HOURLY}", since=since)
    hours = hourly_fact(spark, out).filter(F.col("case_receiving_date") >= F.lit(since))
    write_by_day(facts.daily_from_hours(hours), f"{out}/{DAILY}", since=since)
    State(spark, out).forget()


def hourly_fact(spark: SparkSession, out: str) -> DataFrame:
    schema = SCHEMAS[HOURLY]
    return conform(spark.read.schema(schema).parquet(f"{out}/{HOURLY}"), schema)


def daily_fact(spark: SparkSession, out: str) -> DataFrame:
    schema = SCHEMAS[DAILY]
    return conform(spark.read.schema(schema).parquet(f"{out}/{DAILY}"), schema)


def _directory(spark: SparkSession, inputs: str, only: DataFrame) -> DataFrame:
    return contacts.contact_directory(
        read_table(spark, inputs, "clients"), read_table(spark, inputs, "client_contacts"), only=only
    )


@job
def churn(
    spark: SparkSession,
    inputs: str,
    out: str,
    as_of_ts: dt.datetime,
    *,
    template_id: str = "",
    source: str = "",
    sender: str = "",
    link_base: str | None = None,
    tiers: Sequence[Tier] = CHURN_TIERS,
    min_avg_load: float = 5,
    dedup_keys: Sequence[str] = ("contact_fk",),
    cooldown_on: str = "any",
    only_triggered: bool = False,
) -> None:
    """Churned clients, their contacts, new survey entries and the messages and mails to send.

    Mails go to triggered contacts only, messages to all unless ``only_triggered``.
    """
    as_of = as_of_ts.date()
    state, window = State(spark, out), {"as_of": as_of, "lag_days": LAG_DAYS, "window_days": WINDOW_DAYS}
    options = window | {"tiers": tiers, "min_avg_load": min_avg_load}
    oldest = as_of - days(max(LAG_DAYS + WINDOW_DAYS - 1, *(tier.silent_days for tier in tiers)))
    if state.done and state.through - days(rolling.RING - 1) <= oldest:
        ring = state.ring()
        active = rolling.client_activity(ring, through=state.through, **window)
        churned = rolling.churn_tiers(ring, through=state.through, **options)
    else:
        daily = daily_fact(spark, out)
        active, churned = activity.client_activity(daily, **window), activity.churn_tiers(daily, **options)
    write_report(active, f"{out}/client_activity")
    churned = stage(spark, churned, "churn")
    write_report(churned, f"{out}/churn_clients")

    clients = read_table(spark, inputs, "clients")
    # Only the recent counts of churned clients are used below, so older studies need not be read.
    window_start = as_of - days(LAG_DAYS + WINDOW_DAYS - 1)
    studies = (
        read_table(spark, inputs, "studies")
        .filter(F.to_date("created_at") >= F.lit(window_start))
        .join(churned.select("client_fk"), "client_fk", "left_semi")
    )
    modality = stage(
        spark,
        sla.modality_sla_summary(
            studies, read_table(spark, inputs, "reworks"),
            read_table(spark, inputs, "phase_level_tat"), clients, as_of=as_of, any_status=True,
        ),
        "modality",
    )
    directory = stage(spark, _directory(spark, inputs, churned), "directory")
    write_report(contacts.churn_contacts(churned, directory, modality), f"{out}/churn_contacts")
    reachable = stage(spark, contacts.reachable_contacts(churned, directory, modality), "reachable")
    write_report(reachable, f"{out}/reachable_contacts")

    order = [tier.churn_category for tier in tiers]

    def decide(recent: DataFrame) -> DataFrame:
        return survey.survey_entries(
            reachable, recent, as_of_ts=as_of_ts, tier_order=order, dedup_keys=dedup_keys,
            cooldown_on=cooldown_on,
        )

    log = SurveyLog(spark, f"{out}/client_survey")
    created = log.append(decide, as_of_ts=as_of_ts, reach=days(survey.COOLDOWN_DAYS))
    write_report(created.select(*survey.CREATED_COLUMNS), f"{out}/created_entries")

    merged = survey.survey_merged(created, reachable)
    write_report(merged, f"{out}/survey_contacts")
    to_notify = survey.survey_to_notify(merged)
    write_report(to_notify, f"{out}/to_notify")
    messages = outbox.message_outbox(
        merged, template_id=template_id, source=source, sender=sender, link_base=link_base,
        only_triggered=only_triggered,
    )
    write_report(messages, f"{out}/message_outbox")
    write_report(outbox.modality_payload(to_notify), f"{out}/mail_outbox")


@job
def silent(
    spark: SparkSession, inputs: str, out: str, as_of: dt.date, *, include_silent: bool = False
) -> None:
    """Clients without a case today, their contacts, and low or missing volume."""
    daily = daily_fact(spark, out)
    quiet = stage(spark, activity.silent_clients(daily, as_of=as_of), "silent")
    directory = stage(spark, _directory(spark, inputs, quiet), "directory")
    write_report(quiet, f"{out}/silent_clients")
    write_report(activity.silent_directory(quiet, directory), f"{out}/silent_directory")
    write_report(activity.silent_contacts(quiet, directory), f"{out}/silent_contacts")
    write_report(activity.zero_cases_today(daily, as_of=as_of), f"{out}/zero_cases_today")
    write_report(activity.full_activity_no_cases(daily, as_of=as_of), f"{out}/full_activity_no_cases")
    low = activity.low_activity_today(daily, as_of=as_of, include_silent=include_silent)
    write_report(low, f"{out}/low_activity_today")


@job
def weekdays(
    spark: SparkSession, out: str, as_of: dt.date, *, include_silent: bool = False
) -> None:
    """Today against the same weekday before, by day, hour and interval."""
    daily = facts.by_client_id(daily_fact(spark, out))
    hours = hourly_fact(spark, out)
    oldest = same_weekday_dates(as_of, weeks=4)[-1]
    recent = facts.timed_cases(hours, first=oldest, last=as_of)
    write_report(
        weekday.same_weekday_drop(daily, as_of=as_of, include_silent=include_silent),
        f"{out}/same_weekday_drop",
    )
    write_report(
        weekday.same_weekday_hourly(recent, as_of=as_of), f"{out}/same_weekday_hourly",
        sort_by=["client_id", "hour"],
    )
    state = State(spark, out)
    baseline = (
        weekday.baseline_of(state.totals()) if state.done
        else weekday.weekday_interval_baseline(facts.timed_cases(hours))
    )
    write_report(baseline, f"{out}/weekday_interval_baseline")


@job
def trends(
    spark: SparkSession, out: str, as_of: dt.date, *, year_aware: bool = False, whole_weeks: bool = False
) -> None:
    """Today against yesterday, the weekday, the week and the month."""
    daily = facts.by_client_id(daily_fact(spark, out))
    report = trend.trend_report(daily, as_of=as_of, year_aware=year_aware, whole_weeks=whole_weeks)
    write_report(report, f"{out}/trend_report")


@job
def comparisons(
    spark: SparkSession, out: str, as_of: dt.date, *, cohort_key: str = "client_name"
) -> None:
    """Steady clients over the last three days."""
    daily = facts.by_client_id(daily_fact(spark, out))
    write_report(comparison.daily_cases(daily, as_of=as_of), f"{out}/daily_cases")
    write_report(
        comparison.steady_client_comparison(daily, as_of=as_of, cohort_key=cohort_key),
        f"{out}/steady_client_comparison",
    )


def compact_log(spark: SparkSession, out: str) -> None:
    """Stores the last entry of each contact, so that later runs need not read the whole survey log."""
    SurveyLog(spark, f"{out}/client_survey").compact()


def deliveries(spark: SparkSession, log_path: str, out: str) -> None:
    """Status and result code of each answer in a delivery log."""
    write_report(outbox.delivery_status(spark.read.parquet(log_path)), f"{out}/delivery_status")


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="casepulse.jobs")
    parser.add_argument("job", choices=("daily", "refresh", "churn", "silent", "weekdays", "trends", "comparisons", "compact"))
    parser.add_argument("--inputs", help="folder of the input tables")
    parser.add_argument("--out", required=True, help="folder of the results")
    parser.add_argument("--as-of", type=dt.datetime.fromisoformat, help="day or time the report is for")
    parser.add_argument("--since", type=dt.date.fromisoformat, default=DAILY_SINCE)
    parser.add_argument("--template-id", default="")
    parser.add_argument("--source", default="")
    parser.add_argument("--sender", default="")
    parser.add_argument("--link-base")
    parser.add_argument("--only-triggered", action="store_true", help="no message in the cool-down")
    parser.add_argument("--per-client", action="store_true", help="entries and cool-down by client and contact")
    parser.add_argument("--cooldown-on", choices=("any", "triggered"), default="any")
    parser.add_argument("--include-silent", action="store_true", help="clients without a case today as a drop")
    parser.add_argument("--year-aware", action="store_true", help="months of this year only")
    parser.add_argument("--whole-weeks", action="store_true")
    parser.add_argument("--cohort-key", choices=("client_name", "client_id"), default="client_name")
    given = parser.parse_args(arguments)
    if given.job not in ("daily", "refresh", "compact") and given.as_of is None:
        parser.error("--as-of is required")
    if given.job in ("daily", "refresh", "churn", "silent") and given.inputs is None:
        parser.error("--inputs is required")

    spark = get_spark()
    if given.job == "daily":
        refresh_daily(spark, given.inputs, given.out, given.since)
    elif given.job == "refresh":
        refresh_changed(spark, given.inputs, given.out, given.since)
    elif given.job == "compact":
        compact_log(spark, given.out)
    elif given.job == "churn":
        churn(
            spark, given.inputs, given.out, given.as_of, template_id=given.template_id,
            source=given.source, sender=given.sender, link_base=given.link_base,
            dedup_keys=("client_fk", "contact_fk") if given.per_client else ("contact_fk",),
            cooldown_on=given.cooldown_on, only_triggered=given.only_triggered,
        )
    elif given.job == "silent":
        silent(spark, given.inputs, given.out, given.as_of.date(), include_silent=given.include_silent)
    elif given.job == "weekdays":
        weekdays(spark, given.out, given.as_of.date(), include_silent=given.include_silent)
    elif given.job == "trends":
        trends(
            spark, given.out, given.as_of.date(), year_aware=given.year_aware,
            whole_weeks=given.whole_weeks,
        )
    else:
        comparisons(spark, given.out, given.as_of.date(), cohort_key=given.cohort_key)


if __name__ == "__main__":
    main()
