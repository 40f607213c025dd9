"""The reports' input tables, derived from the test tables by fixed expressions.

``checks.py`` states the same expressions in SQL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casepulse.operators import facts
from casepulse.schemas import Tier

# Parameters of the registered queries, shared with the SQL checks.
CHURN_AS_OF = dt.date(2024, 1, 29)
CHURN_AS_OF_TS = dt.datetime(2024, 1, 29, 9, 0, 0)
EVENTS_LAST_DAY = dt.date(2024, 1, 30)
TREND_AS_OF = dt.date(2001, 7, 31)
SLA_AS_OF = dt.date(2001, 8, 1)
DAILY_FROM = dt.date(2024, 1, 5)
LONG_WINDOW, QUARTER, MANY_WEEKS, FEW_DAYS = 400, 90, 80, 10
SPLIT_PARTS, SPLIT_BUCKETS = 6, 50
OTHER_SLA = {"XRAY": 30, "MRI": 90}
SAMPLE_TIERS = (
    Tier(12, 30, 1, "Tier 1"),
    Tier(10, 11, 3, "Tier 2"),
    Tier(7, 9, 5, "Tier 3"),
)
TEMPLATE_ID, SOURCE_NUMBER, SENDER = "survey-template", "910000000000", "outbox-sender"
LINK_BASE = "https://example.org/survey?id="
CC = ("desk@example.org", "lead@example.org")


class Tables:
    """The test tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._opened: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._opened[name]


def client_label(client: str) -> Column:
    return F.concat(F.lit("client "), F.col(client).cast("string"))


def event_modality() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "click", "XRAY").when(kind == "view", "CT").when(kind == "purchase", "MRI")
        .when(kind == "signup", "NM").otherwise("OTHER")
    )


def order_modality() -> Column:
    urgency = F.substring("o_orderpriority", 1, 1)
    return (
        F.when(urgency == "1", "XRAY").when(urgency == "2", "CT").when(urgency == "3", "MRI")
        .when(urgency == "5", "NM").otherwise("OTHER")
    )


def rules_json(first: Column, second: Column) -> Column:
    return F.concat(F.lit('[{"list":["'), first, F.lit('","'), second, F.lit('"]}]'))


def dense_daily(t: Tables, client: str = "client_fk") -> DataFrame:
    """Events per user and day."""
    cases = t.read("events").select(F.col("user_id").alias(client), "ts")
    return facts.client_day(cases, [client], "ts").withColumn("client_name", client_label(client))


def sparse_daily(t: Tables) -> DataFrame:
    """Purchases per user and day."""
    cases = t.read("events").filter("event_type = 'purchase'")
    cases = cases.select(F.col("user_id").alias("client_fk"), "ts")
    return facts.client_day(cases, ["client_fk"], "ts").withColumn(
        "client_name", client_label("client_fk")
    )


def long_daily(t: Tables) -> DataFrame:
    """Orders per nation and day over several years."""
    owners = t.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nations = t.read("nation").select(
        F.col("n_nationkey").alias("client_id"), F.col("n_name").alias("client_name")
    )
    cases = t.read("orders").select("o_custkey", "o_orderdate").join(owners, "o_custkey")
    counted = facts.client_day(
        cases.withColumnRenamed("c_nationkey", "client_id"), ["client_id"], "o_orderdate"
    )
    return counted.join(nations, "client_id")


def timed_cases(t: Tables) -> DataFrame:
    """One row per event with its time."""
    return t.read("events").select(
        F.col("user_id").alias("client_id"),
        client_label("user_id").alias("client_name"),
        F.col("ts").alias("case_receiving_date"),
        F.lit(1).cast("long").alias("total_case"),
    )


def odd_rules(t: Tables) -> DataFrame:
    """Rules of all shapes: a null, scalar or empty first list, objects, escaped marks, none at all."""
    shape = F.col("event_id") % 10
    kind = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    rules = (
        F.when(shape == 0, F.concat(F.lit('[{"list":null},{"list":['), kind, F.lit("]}]")))
        .when(shape == 1, F.concat(F.lit('[{"list":"MRI"},{"list":['), kind, F.lit("]}]")))
        .when(shape == 2, F.concat(F.lit('[{"list":[]},{"list":['), kind, F.lit("]}]")))
        .when(shape == 3, F.concat(F.lit('[{"list":[{"name":'), kind, F.lit('},"CT"]}]')))
        .when(shape == 4, F.replace(rules_json(F.col("event_type"), F.lit("US")), F.lit('"'), F.lit('\\"')))
        .when(shape == 5, F.concat(F.lit('[{"other":1},{"list":['), kind, F.lit("]}]")))
        .when(shape == 6, F.lit("[{}]"))
        .when(shape == 7, F.lit(""))
        .when(shape == 8, rules_json(event_modality(), F.col("event_type")))
    )
    return t.read("events").select(F.col("event_id").alias("id"), rules.alias("rules"))


def event_times(t: Tables) -> DataFrame:
    """The events' times as text, some of them malformed."""
    given = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return t.read("events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("at "), given)).otherwise(given).alias("at"),
    )


def shared_account_log(t: Tables) -> DataFrame:
    """The survey log, with entries of a third of the clients for their account, contact 0."""
    log = customer_survey_log(t)
    own = log.filter(F.col("client_fk") % 3 == 0).withColumns(
        {"id": F.col("id") + 10_000_000, "contact_fk": F.lit(0).cast("long"), "trigger": F.lit(True)}
    )
    return log.unionByName(own)


def event_studies(t: Tables) -> DataFrame:
    share = F.get_json_object("props", "$.k").cast("int")
    return t.read("events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("client_fk"),
        F.col("ts").alias("created_at"),
        F.when(share >= 90, "OPEN").otherwise("COMPLETED").alias("status"),
        rules_json(event_modality(), F.col("event_type")).alias("rules"),
    )


def event_details(t: Tables) -> DataFrame:
    return t.read("events").filter("event_type <> 'view'").select(
        F.col("event_id").alias("study_fk"), (F.col("value") > 100).alias("is_demo")
    )


def event_client_tat(t: Tables) -> DataFrame:
    """Signups have no time, purchases two."""
    events = t.read("events")
    first = events.filter("event_type <> 'signup'").select(
        F.col("event_id").alias("study_id"), event_modality().alias("modality"), F.col("value").alias("tat_min")
    )
    second = events.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("study_id"), F.lit("ADDON").alias("modality"), (F.col("value") * 2).alias("tat_min")
    )
    return first.unionByName(second)


def event_phase_tat(t: Tables) -> DataFrame:
    return t.read("events").select(
        F.col("event_id").alias("study_id"), F.col("value").alias("overall_tat")
    )


def account_email(key: Column) -> Column:
    return F.when(key % 11 >= 4, F.concat(F.lit("c"), key.cast("string"), F.lit("@example.org")))


def customer_clients(t: Tables) -> DataFrame:
    segment = F.col("c_mktsegment")
    return t.read("customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("client_name"),
        F.date_add(F.lit(dt.date(2023, 1, 1)), F.col("c_nationkey")).alias("onboarded_at"),
        F.when(segment == "MACHINERY", True).when(segment != "BUILDING", False).alias("saas_only"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("oms_partner"),
        F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("unique_id"),
        account_email(F.col("c_custkey")).alias("email"),
    )


def customer_details(t: Tables) -> DataFrame:
    return t.read("customer").filter("c_acctbal > 1000").select(
        F.col("c_custkey").alias("client_fk"), F.col("c_mktsegment").alias("client_source")
    )


def customer_settings(t: Tables) -> DataFrame:
    nation = F.col("c_nationkey")
    return t.read("customer").filter(nation != 3).select(
        F.col("c_custkey").alias("client_fk"),
        (nation == 5).alias("enable_demo"),
        F.when(nation == 7, "demo").when(nation != 8, "postpaid").alias("billing_type"),
    )


def user_count(t: Tables) -> Column:
    return t.read("events").agg(F.count_distinct("user_id")).scalar()


def customer_contacts(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    digits = F.lpad(key.cast("string"), 10, "0")
    branch = key % 7
    return t.read("customer").select(
        key.alias("id"),
        (key % user_count(t)).alias("client_fk"),
        F.when(branch == 1, "NA")
        .when(branch == 2, F.concat(F.lit("+91-"), digits))
        .when(branch == 3, F.concat(F.lit("91-"), digits))
        .when(branch == 4, F.substring(digits, 3, 8))
        .when(branch == 5, "")
        .when(branch == 6, digits)
        .alias("phone"),
        account_email(key).alias("email"),
        F.concat(F.lit('["'), F.col("c_mktsegment"), F.lit('"]')).alias("designation"),
        F.lower("c_mktsegment").alias("persona_type"),
    )


def customer_survey_log(t: Tables) -> DataFrame:
    """Entries 1 to 14 days old for part of the contacts, and a second one 30 days older."""
    key = F.col("c_custkey")
    now = F.lit(CHURN_AS_OF_TS.isoformat(" ")).cast("timestamp_ntz")
    recent = t.read("customer").filter("c_acctbal < 5000").select(
        key.alias("id"),
        key.alias("contact_fk"),
        (key % user_count(t)).alias("client_fk"),
        F.lit("DAU").alias("client_active_type"),
        F.col("c_mktsegment").alias("churn_type"),
        F.lit(None).cast("string").alias("response"),
        (F.col("c_nationkey") < 12).alias("trigger"),
        (now - F.make_dt_interval(key % 14 + 1)).alias("created_at"),
    )
    older = recent.filter("churn_type = 'HOUSEHOLD'").withColumns(
        {
            "id": -F.col("id") - 1,
            "created_at": F.col("created_at") - F.expr("INTERVAL 30 DAYS"),
        }
    )
    return recent.unionByName(older).withColumn("updated_at", F.col("created_at"))


def order_studies(t: Tables) -> DataFrame:
    owners = t.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return t.read("orders").join(owners, "o_custkey").select(
        F.col("o_orderkey").alias("id"),
        F.col("c_nationkey").cast("long").alias("client_fk"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("OPEN").alias("status"),
        rules_json(order_modality(), F.col("o_orderpriority")).alias("rules"),
    )


def order_phase_tat(t: Tables) -> DataFrame:
    """Cheap orders have no time."""
    return t.read("orders").filter("o_totalprice >= 20000").select(
        F.col("o_orderkey").alias("study_id"), (F.col("o_totalprice") / 2000).alias("overall_tat")
    )


def line_reworks(t: Tables) -> DataFrame:
    """Returned lines; several may belong to one study."""
    quantity = F.col("l_quantity")
    return t.read("lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_linenumber").cast("long").alias("id"),
        F.col("l_orderkey").alias("study_fk"),
        F.col("l_shipdate").alias("created_at"),
        F.when(F.col("l_linestatus") == "F", "COMPLETED").otherwise("OPEN").alias("status"),
        F.when(quantity <= 20, "CLIENT").when(quantity <= 40, "ACCOUNT_MANAGER")
        .otherwise("REPORTER").alias("by_user_type"),
        F.when(F.col("l_discount") > 0.05, 1).cast("long").alias("complete_reason_fk"),
    )


def nation_clients(t: Tables) -> DataFrame:
    """Nations as clients; one of them is missing from the table."""
    return t.read("nation").filter("n_name <> 'NATION_9'").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("client_name")
    )


def delivery_log(t: Tables) -> DataFrame:
    """Answers of all kinds: accepted, refused, without a status, and not JSON."""
    kind = F.col("event_type")
    answer = (
        F.when(kind == "click", '{"status":"queued"}').when(kind == "view", '{"status":"sent"}')
        .when(kind == "purchase", '{"status":"rejected"}').when(kind == "signup", F.col("props"))
        .otherwise(F.concat(F.lit("<html>"), F.col("props")))
    )
    return t.read("events").select(F.col("event_id").alias("message_id"), answer.alias("response"))
