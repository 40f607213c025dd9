"""Every report and reusable step as a query over the test tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casepulse.functions import dates, numbers, text
from casepulse.operators import (
    activity,
    comparison,
    contacts,
    facts,
    keyed,
    outbox,
    rolling,
    sla,
    survey,
    trend,
    weekday,
)
from casepulse.plans import bindings as b
from casepulse.plans.bindings import Tables
from casepulse.refresh import refresh_changed
from casepulse.schemas import SCHEMAS
from casepulse.session import shared_folder
from casepulse.sources import splits
from casepulse.sources.survey_log import SurveyLog
from casepulse.sources.writers import stage, write_report

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = build
    return build


# --- facts -------------------------------------------------------------------------------


@query
def client_day_counts(t: Tables) -> DataFrame:
    return b.dense_daily(t)


@query
def daily_client_cases(t: Tables) -> DataFrame:
    return facts.daily_client_cases(
        b.event_studies(t), b.event_details(t), b.customer_clients(t), b.customer_details(t),
        b.customer_settings(t), b.event_client_tat(t), since=b.DAILY_FROM,
    )


def _case_tables(t: Tables) -> list[DataFrame]:
    return [
        b.event_studies(t), b.event_details(t), b.customer_clients(t), b.customer_details(t),
        b.customer_settings(t), b.event_client_tat(t),
    ]


@query
def balanced_splits(t: Tables) -> DataFrame:
    """Rows of each part of a split read of the orders by client, some of which have none."""
    orders = t.read("orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("key"))
    found = splits.split_predicates(orders, "key", b.SPLIT_PARTS, buckets=b.SPLIT_BUCKETS)
    part = F.coalesce(*(F.when(F.expr(condition), k) for k, condition in enumerate(found)))
    return orders.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("orders"), F.min("key").alias("first_key"))


@query
def csv_report(t: Tables) -> DataFrame:
    """Client days through a sorted CSV report and back."""
    daily, path = b.dense_daily(t), f"{shared_folder(t.spark)}/report-{uuid.uuid4().hex}"
    write_report(daily, path, "csv", sort_by=["client_fk", "case_receiving_date"])
    return t.spark.read.schema(daily.schema).option("header", "true").csv(path)


@query
def hourly_client_cases(t: Tables) -> DataFrame:
    return facts.hourly_client_cases(*_case_tables(t), since=b.DAILY_FROM)


@query
def timed_cases(t: Tables) -> DataFrame:
    """The hourly fact as the hourly reports read it, over two weeks."""
    last = b.DAILY_FROM + dates.days(13)
    return facts.timed_cases(hourly_client_cases(t), first=b.DAILY_FROM, last=last)


@query
def daily_from_hours(t: Tables) -> DataFrame:
    """The daily fact summed from the hourly one, under the id's other name."""
    return facts.by_client_id(facts.daily_from_hours(hourly_client_cases(t)))


@query
def daily_client_cases_refreshed(t: Tables) -> DataFrame:
    """The daily fact after a refresh of what has changed since an earlier state of the tables."""
    folder = f"{shared_folder(t.spark)}/refresh-{uuid.uuid4().hex}"
    names = ("studies", "study_details", "clients", "client_details", "client_settings", "client_tat_metrics")
    for name, table in zip(names, _case_tables(t), strict=True):
        table.write.parquet(f"{folder}/now/{name}.parquet")
    # The earlier state comes from the stored tables, so that the events are parsed once.
    now = {name: t.spark.read.parquet(f"{folder}/now/{name}.parquet") for name in names}
    late = F.col("id") % 37 == 0
    before = now | {
        # Some studies were open and some not there; some details and times came later; a client had another name.
        "studies": now["studies"].filter("id % 41 <> 0").withColumn("status", F.when(late, "OPEN").otherwise(F.col("status"))),
        "study_details": now["study_details"].filter("study_fk % 43 <> 0"),
        "client_tat_metrics": now["client_tat_metrics"].filter("study_id % 47 <> 0"),
        "clients": now["clients"].withColumn("client_name", F.when(F.col("id") % 10 == 1, "before").otherwise(F.col("client_name"))),
    }
    for name, table in before.items():
        table.write.parquet(f"{folder}/before/{name}.parquet")
    for state in ("before", "now"):
        refresh_changed(t.spark, f"{folder}/{state}", f"{folder}/out", since=b.DAILY_FROM)
    return t.spark.read.schema(SCHEMAS["daily_client_cases"]).parquet(f"{folder}/out/daily_client_cases")


@query
def daily_client_cases_excluding(t: Tables) -> DataFrame:
    """Excluded clients come from a table, and studies without a time are left out of the target counts."""
    excluded = t.read("customer").filter("c_mktsegment = 'FURNITURE'").select("c_custkey")
    return facts.daily_client_cases(
        *_case_tables(t), since=b.DAILY_FROM, exclude=excluded, missing_tat="exclude", unescape="single"
    )


@query
def modality_sla_summary(t: Tables) -> DataFrame:
    return sla.modality_sla_summary(
        b.order_studies(t), b.line_reworks(t), b.order_phase_tat(t), b.nation_clients(t),
        as_of=b.SLA_AS_OF,
    )


@query
def modality_sla_month(t: Tables) -> DataFrame:
    return sla.modality_sla_month(
        b.order_studies(t), b.order_phase_tat(t), b.nation_clients(t), as_of=b.TREND_AS_OF
    )


@query
def modality_sla_distinct(t: Tables) -> DataFrame:
    """Each study counts once, the recent block takes completed studies, missing times are left out."""
    return sla.modality_sla_summary(
        b.order_studies(t), b.line_reworks(t), b.order_phase_tat(t), b.nation_clients(t),
        as_of=b.SLA_AS_OF, distinct_studies=True, completed_only_recent=True, missing_tat="exclude",
    )


@query
def modality_sla_other_targets(t: Tables) -> DataFrame:
    """Other targets, ten recent days."""
    return sla.modality_sla_summary(
        b.order_studies(t), b.line_reworks(t), b.order_phase_tat(t), b.nation_clients(t),
        as_of=b.SLA_AS_OF, recent_days=b.FEW_DAYS, sla=b.OTHER_SLA,
    )


@query
def json_modality_odd(t: Tables) -> DataFrame:
    return b.odd_rules(t).select("id", text.modality(F.col("rules")).alias("modality"))


@query
def parsed_times(t: Tables) -> DataFrame:
    """Lenient parse of text; strict parse of its day where that worked."""
    at = dates.parse_timestamp_or_null(F.col("at"))
    day = F.when(at.isNotNull(), dates.parse_date(F.substring("at", 1, 10)))
    return b.event_times(t).select("id", at.cast("timestamp_ntz").alias("parsed"), day.alias("day"))


@query
def json_modality(t: Tables) -> DataFrame:
    return b.event_studies(t).select("id", text.modality(F.col("rules")).alias("modality"))


@query
def json_study_name(t: Tables) -> DataFrame:
    return b.event_studies(t).select("id", text.study_name(F.col("rules")).alias("study_name"))


# --- activity and churn ------------------------------------------------------------------


@query
def client_activity(t: Tables) -> DataFrame:
    return activity.client_activity(b.dense_daily(t), as_of=b.CHURN_AS_OF)


def _churn(t: Tables) -> DataFrame:
    return activity.churn_tiers(
        b.sparse_daily(t), as_of=b.CHURN_AS_OF, tiers=b.SAMPLE_TIERS, min_avg_load=1
    )


@query
def churn_tiers(t: Tables) -> DataFrame:
    return _churn(t)


def _ring(t: Tables) -> tuple[DataFrame, dt.date]:
    """Rings of two days ago, in which one day was other than it is now, moved on by a day and that day taken back."""
    daily, earlier, through = b.sparse_daily(t), b.CHURN_AS_OF - dates.days(9), b.CHURN_AS_OF - dates.days(2)
    other = F.when(F.col("case_receiving_date") == F.lit(earlier), F.col("total_case") * 5).otherwise(F.col("total_case"))
    before = daily.withColumn("total_case", other).filter(
        (F.col("case_receiving_date") <= F.lit(through)) & ((F.col("case_receiving_date") != F.lit(earlier)) | (F.col("client_fk") % 3 == 0))
    )
    state = stage(t.spark, rolling.window_state(before, through=through), "ring")
    now = through + dates.days(1)
    return rolling.advanced(state, daily, through=through, to=now, replaced=[earlier]), now


@query
def churn_tiers_rolling(t: Tables) -> DataFrame:
    ring, through = _ring(t)
    return rolling.churn_tiers(ring, through=through, as_of=b.CHURN_AS_OF, tiers=b.SAMPLE_TIERS, min_avg_load=1)


@query
def client_activity_rolling(t: Tables) -> DataFrame:
    ring, through = _ring(t)
    return rolling.client_activity(ring, through=through, as_of=b.CHURN_AS_OF)


@query
def client_activity_long(t: Tables) -> DataFrame:
    """Active days in a window of 400 days."""
    daily = b.long_daily(t).withColumnRenamed("client_id", "client_fk")
    return activity.client_activity(daily, as_of=b.TREND_AS_OF, window_days=b.LONG_WINDOW)


@query
def daily_volume_long(t: Tables) -> DataFrame:
    """The volume watch over a window of 90 days."""
    daily = b.long_daily(t).withColumnRenamed("client_id", "client_fk")
    return activity.daily_volume(daily, as_of=b.TREND_AS_OF, min_avg_load=0, window_days=b.QUARTER)


@query
def silent_clients(t: Tables) -> DataFrame:
    return activity.silent_clients(b.dense_daily(t), as_of=b.EVENTS_LAST_DAY)


def _directory(t: Tables, only: DataFrame | None = None) -> DataFrame:
    return contacts.contact_directory(b.customer_clients(t), b.customer_contacts(t), only=only)


@query
def silent_directory(t: Tables) -> DataFrame:
    silent = silent_clients(t)
    return activity.silent_directory(silent, _directory(t, silent), b.customer_contacts(t))


@query
def silent_contacts(t: Tables) -> DataFrame:
    silent = silent_clients(t)
    return activity.silent_contacts(silent, _directory(t, silent), b.customer_contacts(t))


@query
def zero_cases_today(t: Tables) -> DataFrame:
    return activity.zero_cases_today(b.dense_daily(t), as_of=b.CHURN_AS_OF)


@query
def full_activity_no_cases(t: Tables) -> DataFrame:
    return activity.full_activity_no_cases(
        b.dense_daily(t), as_of=b.CHURN_AS_OF, min_active_days=23
    )


@query
def low_activity_today(t: Tables) -> DataFrame:
    return activity.low_activity_today(b.dense_daily(t), as_of=b.CHURN_AS_OF)


@query
def low_activity_or_silent(t: Tables) -> DataFrame:
    return activity.low_activity_today(
        b.dense_daily(t), as_of=b.CHURN_AS_OF, include_silent=True
    )


# --- drops against earlier days ----------------------------------------------------------


@query
def same_weekday_drop(t: Tables) -> DataFrame:
    return weekday.same_weekday_drop(b.dense_daily(t, "client_id"), as_of=b.CHURN_AS_OF)


@query
def same_weekday_drop_with_silent(t: Tables) -> DataFrame:
    return weekday.same_weekday_drop(
        b.dense_daily(t, "client_id"), as_of=b.CHURN_AS_OF, include_silent=True
    )


@query
def same_weekday_drop_long(t: Tables) -> DataFrame:
    """Against 80 earlier weeks."""
    return weekday.same_weekday_drop(b.long_daily(t), as_of=b.TREND_AS_OF, weeks=b.MANY_WEEKS)


@query
def same_weekday_hourly(t: Tables) -> DataFrame:
    return weekday.same_weekday_hourly(b.timed_cases(t), as_of=b.CHURN_AS_OF)


@query
def same_weekday_hourly_present(t: Tables) -> DataFrame:
    """Past hours over the days that have them; no percentage for a new hour."""
    return weekday.same_weekday_hourly(
        b.timed_cases(t), as_of=b.CHURN_AS_OF, divisor="present", zero_baseline=None
    )


@query
def weekday_interval_baseline(t: Tables) -> DataFrame:
    return weekday.weekday_interval_baseline(b.timed_cases(t))


@query
def weekday_interval_baseline_running(t: Tables) -> DataFrame:
    """From running totals: of all days but the last, with one day as it was before; those two days are read anew."""
    cases, day = b.timed_cases(t), F.to_date("case_receiving_date")
    replaced, last = b.CHURN_AS_OF - dates.days(5), b.EVENTS_LAST_DAY
    was = cases.filter(day < F.lit(last)).withColumn(
        "total_case", F.when(day == F.lit(replaced), 3 * F.col("total_case")).otherwise(F.col("total_case"))
    )
    totals = stage(t.spark, weekday.interval_totals(was), "totals")
    new = cases.filter((day == F.lit(replaced)) | (day >= F.lit(last)))
    return weekday.baseline_of(weekday.replaced_totals(totals, was.filter(day == F.lit(replaced)), new))


@query
def daily_cases(t: Tables) -> DataFrame:
    return comparison.daily_cases(b.dense_daily(t, "client_id"), as_of=b.EVENTS_LAST_DAY)


@query
def steady_client_comparison(t: Tables) -> DataFrame:
    return comparison.steady_client_comparison(
        b.dense_daily(t, "client_id"), as_of=b.EVENTS_LAST_DAY, min_cases=0
    )


@query
def steady_client_comparison_by_id(t: Tables) -> DataFrame:
    return comparison.steady_client_comparison(
        b.dense_daily(t, "client_id"), as_of=b.EVENTS_LAST_DAY, min_cases=0, cohort_key="client_id"
    )


@query
def trend_report(t: Tables) -> DataFrame:
    return trend.trend_report(b.long_daily(t), as_of=b.TREND_AS_OF)


@query
def trend_report_calendar(t: Tables) -> DataFrame:
    """Months of this year and whole weeks only."""
    return trend.trend_report(
        b.long_daily(t), as_of=b.TREND_AS_OF, year_aware=True, whole_weeks=True
    )


@query
def last_same_weekdays(t: Tables) -> DataFrame:
    return trend.last_same_weekdays(b.long_daily(t), as_of=b.TREND_AS_OF)


@query
def yesterday_cases(t: Tables) -> DataFrame:
    return trend.yesterday_cases(b.long_daily(t), as_of=b.TREND_AS_OF)


@query
def today_cases(t: Tables) -> DataFrame:
    return trend.today_cases(b.long_daily(t), as_of=b.TREND_AS_OF)


@query
def week_to_date(t: Tables) -> DataFrame:
    return trend.week_to_date(b.long_daily(t), as_of=b.TREND_AS_OF)


@query
def month_cases(t: Tables) -> DataFrame:
    return trend.month_cases(b.long_daily(t), as_of=b.TREND_AS_OF)


@query
def last_3_weeks(t: Tables) -> DataFrame:
    return trend.last_3_weeks(b.long_daily(t), as_of=b.TREND_AS_OF)


@query
def last_3_months(t: Tables) -> DataFrame:
    return trend.last_3_months(b.long_daily(t), as_of=b.TREND_AS_OF)


@query
def drop_percentages(t: Tables) -> DataFrame:
    """The changes alone, at row grain."""
    report = trend.trend_report(b.long_daily(t), as_of=b.TREND_AS_OF, grain="row")
    return report.select("client_id", *[c for c in report.columns if c.startswith("drop_")])


# --- contacts, survey and messages -------------------------------------------------------


@query
def contact_directory(t: Tables) -> DataFrame:
    return _directory(t)


@query
def survey_history(t: Tables) -> DataFrame:
    return survey.survey_history(b.customer_survey_log(t))


def _staged_churn(t: Tables) -> DataFrame:
    return stage(t.spark, _churn(t), "churn")


def _recent_modality(t: Tables, churn: DataFrame) -> DataFrame:
    """Modality counts of the churned clients only; others would be dropped by the join."""
    studies = b.event_studies(t).join(churn.select("client_fk"), "client_fk", "left_semi")
    return sla.modality_sla_summary(
        studies, b.line_reworks(t), b.event_phase_tat(t),
        b.customer_clients(t).select("id", "client_name"), as_of=b.CHURN_AS_OF,
    )


@query
def churn_contacts(t: Tables) -> DataFrame:
    churn = _staged_churn(t)
    return contacts.churn_contacts(churn, _directory(t, churn), _recent_modality(t, churn), b.customer_contacts(t))


@query
def churn_contacts_plain(t: Tables) -> DataFrame:
    """The same without the recent counts."""
    return keyed.drop_matching(churn_contacts(t), "Last_30_")


@query
def reachable_contacts(t: Tables) -> DataFrame:
    churn = _staged_churn(t)
    return contacts.reachable_contacts(churn, _directory(t, churn), _recent_modality(t, churn), b.customer_contacts(t))


def _entries(t: Tables, reachable: DataFrame) -> DataFrame:
    return survey.survey_entries(
        reachable, b.customer_survey_log(t), as_of_ts=b.CHURN_AS_OF_TS,
        tier_order=[tier.churn_category for tier in b.SAMPLE_TIERS],
    )


@query
def survey_entries(t: Tables) -> DataFrame:
    return _entries(t, reachable_contacts(t))


@query
def survey_entries_per_client(t: Tables) -> DataFrame:
    """One entry and one cool-down per client and contact, of triggered entries; accounts share contact 0."""
    return survey.survey_entries(
        reachable_contacts(t), b.shared_account_log(t), as_of_ts=b.CHURN_AS_OF_TS,
        dedup_keys=("client_fk", "contact_fk"), cooldown_on="triggered",
        tier_order=[tier.churn_category for tier in b.SAMPLE_TIERS],
    )


def _created(t: Tables, reachable: DataFrame) -> DataFrame:
    """Entries with ids, staged: the numbering reads them twice and the log grows by them."""
    entries = stage(t.spark, _entries(t, reachable), "entries")
    return survey.with_created_id(entries, b.customer_survey_log(t), as_of_ts=b.CHURN_AS_OF_TS)


@query
def survey_append(t: Tables) -> DataFrame:
    created = _created(t, reachable_contacts(t))
    return survey.new_entries(created, b.customer_survey_log(t), as_of_ts=b.CHURN_AS_OF_TS)


@query
def survey_rerun(t: Tables) -> DataFrame:
    """Ids of a run that is repeated after half of its entries were appended."""
    entries = stage(t.spark, _entries(t, reachable_contacts(t)), "entries")
    log = b.customer_survey_log(t)
    first = survey.with_created_id(entries.filter("contact_fk % 2 = 0"), log, as_of_ts=b.CHURN_AS_OF_TS)
    held = stage(t.spark, survey.new_entries(first, log, as_of_ts=b.CHURN_AS_OF_TS), "held")
    grown = log.unionByName(held)
    again = survey.with_created_id(entries, grown, as_of_ts=b.CHURN_AS_OF_TS)
    ids = held.select("client_fk", "contact_fk", F.col("id").alias("log_id"))
    known = keyed.null_safe_left_join(again, ids, ["client_fk", "contact_fk"])
    return known.select(
        "client_fk", "contact_fk", F.col("log_id").isNotNull().alias("held"),
        F.coalesce(F.col("created_id") == F.col("log_id"), F.lit(False)).alias("same_id"),
        F.count(F.lit(1)).over(Window.partitionBy("created_id")).alias("uses_of_id"),
        (F.col("created_id") > log.agg(F.max("id")).scalar()).alias("after_log"),
    )


@query
def survey_two_runs(t: Tables) -> DataFrame:
    """Two runs that append at once: the one that began first loses its number and decides again."""
    log, reachable = SurveyLog(t.spark, f"{shared_folder(t.spark)}/log-{uuid.uuid4().hex}"), stage(t.spark, reachable_contacts(t), "reachable")
    log.adopt(b.customer_survey_log(t))
    last_id, early = log.head()["last_id"], b.CHURN_AS_OF_TS - dt.timedelta(hours=1)

    def append(as_of_ts: dt.datetime, meanwhile: list[dt.datetime]) -> None:
        def decide(recent: DataFrame) -> DataFrame:
            entries = stage(t.spark, survey.survey_entries(
                reachable, recent, as_of_ts=as_of_ts, tier_order=[tier.churn_category for tier in b.SAMPLE_TIERS]
            ), "decided")
            while meanwhile:
                append(meanwhile.pop(), [])
            return entries

        log.append(decide, as_of_ts=as_of_ts, reach=dates.days(survey.COOLDOWN_DAYS))

    append(b.CHURN_AS_OF_TS, [early])
    return log.read(since=b.CHURN_AS_OF).select(
        "client_fk", "contact_fk", "trigger", "created_at",
        F.count(F.lit(1)).over(Window.partitionBy("id")).alias("uses_of_id"),
        (F.col("id") <= F.lit(log.head()["last_id"])).alias("known"),
        (F.col("id") > F.lit(last_id)).alias("after_log"),
    )


@query
def last_survey_entries_snapshot(t: Tables) -> DataFrame:
    """From a snapshot of older entries and the entries since."""
    log, entries = SurveyLog(t.spark, f"{shared_folder(t.spark)}/log-{uuid.uuid4().hex}"), b.customer_survey_log(t)
    recent = F.col("created_at") >= F.lit(b.CHURN_AS_OF - dates.days(5))
    log.adopt(entries.filter(~recent))
    log.compact()
    log.adopt(entries.filter(recent))
    return log.last_entries()


@query
def last_survey_entries(t: Tables) -> DataFrame:
    return survey.last_entries(b.customer_survey_log(t))


def _merged(t: Tables) -> DataFrame:
    reachable = stage(t.spark, reachable_contacts(t), "reachable")
    return survey.survey_merged(_created(t, reachable), reachable)


@query
def survey_merged(t: Tables) -> DataFrame:
    return _merged(t)


@query
def survey_to_notify(t: Tables) -> DataFrame:
    return survey.survey_to_notify(_merged(t))


def _outbox(t: Tables, only_triggered: bool = False) -> DataFrame:
    messages = outbox.message_outbox(
        _merged(t), template_id=b.TEMPLATE_ID, source=b.SOURCE_NUMBER, sender=b.SENDER,
        link_base=b.LINK_BASE, only_triggered=only_triggered,
    )
    return messages.withColumn("params", F.array_join("params", "|"))


@query
def message_outbox(t: Tables) -> DataFrame:
    return _outbox(t)


@query
def message_outbox_triggered(t: Tables) -> DataFrame:
    return _outbox(t, only_triggered=True)


@query
def modality_payload(t: Tables) -> DataFrame:
    rows = outbox.modality_payload(survey.survey_to_notify(_merged(t)))
    return rows.select("created_id", "client_fk", "contact_fk", "Client_Name", F.inline("modality_data"))


@query
def mail_recipients(t: Tables) -> DataFrame:
    mails = outbox.mail_recipients(
        outbox.modality_payload(survey.survey_to_notify(_merged(t))), F.array(*[F.lit(address) for address in b.CC])
    )
    entries = mails.select("created_id", "contact_fk", F.inline("recipients"))
    return entries.withColumnsRenamed({"email": "address", "type": "kind"})


@query
def delivery_status(t: Tables) -> DataFrame:
    return outbox.delivery_status(b.delivery_log(t))


# --- scalar functions over whole tables --------------------------------------------------


@query
def phone_numbers(t: Tables) -> DataFrame:
    phone = text.null_na(F.col("phone"))
    return b.customer_contacts(t).select(
        "id",
        text.clean_phone(phone).alias("destination"),
        F.coalesce(text.is_local_phone(text.strip_country_code(phone)), F.lit(False)).alias("phone_valid"),
    )


@query
def percent_format(t: Tables) -> DataFrame:
    share = numbers.guarded_pct("l_tax", "l_discount")
    change = numbers.round_pct(numbers.pct_diff("l_tax", "l_discount"))
    return t.read("lineitem").groupBy(
        "l_linenumber", numbers.format_pct(share).alias("share"), change.alias("change")
    ).agg(F.count(F.lit(1)).alias("lines"))


@query
def calendar_parts(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    return t.read("orders").groupBy(
        F.weekday(day).alias("weekday"),
        dates.weekday_name(day).alias("weekday_name"),
        F.month(day).alias("month"),
        F.weekofyear(day).alias("iso_week"),
        F.to_date(F.date_trunc("week", day)).alias("monday"),
    ).agg(F.count(F.lit(1)).alias("orders"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: build(Tables(spark, folder))

    return {name: bind(build) for name, build in QUERIES.items()}
