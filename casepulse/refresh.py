"""Facts, running means and windows kept up to date by the days that have changed.

Digests of the source tables by day and block of study ids, stored by the refresh before, tell
which days to rebuild. Counts per client, day and hour are stored before they meet the clients, so a client that
changes costs no raw read. What a refresh makes is written beside the tables and committed as
prepared; only then do the changed days replace the stored ones, and a second commit ends it. A refresh
that finds a prepared one does its last step again, so old days are taken back from the means exactly once.
"""

from __future__ import annotations

import datetime as dt
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casepulse.functions.dates import on_days
from casepulse.operators import digests, facts, rolling, weekday
from casepulse.schemas import DAILY_SINCE, SCHEMAS
from casepulse.sources.commits import Commits
from casepulse.sources.readers import conform, read_table
from casepulse.sources.writers import remove_folder, stage, staging, write_by_day

COUNTS, HOURLY, DAILY = "client_case_counts", "hourly_client_cases", "daily_client_cases"
DAY = "case_receiving_date"
COUNTS_SCHEMA = f"client_fk long, {DAY} date, hour int, " + ", ".join(f"{name} long" for name in (*facts.MEASURES, *facts.REAL_MEASURES))
TOTALS_SCHEMA = "client_id long, weekday int, bucket int, cases long, days long"


class State:
    """What the last refresh below a folder of results left."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out
        self.commits = Commits(spark, f"{out}/refresh/commits")
        self.content: dict[str, Any] = self.commits.last() or {"number": 0, "kind": "none"}

    @property
    def done(self) -> bool:
        return self.content["kind"] == "done"

    @property
    def through(self) -> dt.date:
        return dt.date.fromisoformat(self.content["through"])

    def table(self, name: str, schema: Any) -> DataFrame:
        """A table of the state; empty where there is none."""
        if self.content["kind"] == "none":
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.out}/{self.content['folder']}/{name}")

    def totals(self) -> DataFrame:
        return self.table("totals", TOTALS_SCHEMA)

    def ring(self) -> DataFrame:
        return self.table("ring", rolling.SCHEMA)

    def commit(self, **content: Any) -> None:
        if not self.commits.create(self.content["number"] + 1, content):
            raise RuntimeError("another refresh has run at the same time")
        self.content = content | {"number": self.content["number"] + 1}

    def forget(self) -> None:
        """The facts were written otherwise, so the next refresh starts anew."""
        if self.content["kind"] != "none":
            self.commit(kind="none")

    def finish(self) -> None:
        """Replaces the changed days; any number of times with one result."""
        days = {name: [dt.date.fromisoformat(day) for day in self.content[name]] for name in ("changed", "affected")}
        # After a first run, days of earlier, other writers from ``since`` on go as well.
        since = dt.date.fromisoformat(self.content["since"]) if self.content.get("first") else None
        write_by_day(self.table(COUNTS, COUNTS_SCHEMA), f"{self.out}/{COUNTS}", days=days["changed"], staged=True)
        for name in (HOURLY, DAILY):
            write_by_day(self.table(name, SCHEMAS[name]), f"{self.out}/{name}", since=since, days=days["affected"], staged=True)
        self.commit(**{k: v for k, v in self.content.items() if k not in ("kind", "number", "first")}, kind="done")


def _days(df: DataFrame) -> set[dt.date]:
    """Calendar days, not rows."""
    return {row[0] for row in df.collect()}


def refresh_changed(spark: SparkSession, inputs: str, out: str, since: dt.date = DAILY_SINCE) -> list[dt.date]:
    """Brings both facts, the interval totals and the rings up to date; the days that were rebuilt.

    The result is what a full refresh of all days from ``since`` gives. The first run, or one with
    another ``since``, rebuilds all days. One writer at a time; a second one fails.
    """
    with staging(spark):
        return _refresh(spark, inputs, out, since)


def _refresh(spark: SparkSession, inputs: str, out: str, since: dt.date) -> list[dt.date]:
    state = State(spark, out)
    if state.content["kind"] == "prepared":
        state.finish()
    if state.done and state.content["since"] != since.isoformat():
        state.forget()
    first_run, folder = not state.done, f"refresh/{uuid.uuid4().hex}"

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{out}/{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{out}/{folder}/{name}")

    def stored(name: str, schema: Any, on: set[dt.date]) -> DataFrame:
        if first_run or not on:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{out}/{name}").filter(on_days(DAY, on))

    studies, details, tat = (read_table(spark, inputs, n) for n in ("studies", "study_details", "client_tat_metrics"))
    dims = [read_table(spark, inputs, n) for n in ("clients", "client_details", "client_settings")]
    studies = studies.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    cases = kept("cases", digests.case_digests(studies, details, tat))
    clients = kept("clients", digests.client_digests(*dims))
    changed = _days(digests.changed_days(cases, state.table("cases", cases.schema)))

    # Other days of clients that have changed come from the stored counts.
    affected = set(changed)
    if not first_run:
        who = stage(spark, digests.changed(clients, state.table("clients", clients.schema), ["source", "client_fk"]).select("client_fk").distinct(), "who")
        counts = spark.read.schema(COUNTS_SCHEMA).parquet(f"{out}/{COUNTS}")
        affected |= _days(counts.join(who, "client_fk", "left_semi").select(DAY).distinct())
    if not affected and not first_run:
        remove_folder(spark, f"{out}/{folder}")
        return []

    blocks = cases.filter(F.col("source") == "studies").filter(on_days("day", changed)).agg(
        F.min("block"), F.max("block")
    ).first()
    low, high = ((blocks[0] or 0) * digests.BLOCK, ((blocks[1] or 0) + 1) * digests.BLOCK)
    counted = kept(COUNTS, facts.client_case_counts(
        studies.filter(on_days("created_at", changed, time=True)),
        details.filter((F.col("study_fk") >= low) & (F.col("study_fk") < high)),
        tat.filter((F.col("study_id") >= low) & (F.col("study_id") < high)), since=since, by_hour=True,
    ).select(*(F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], COUNTS_SCHEMA).schema)))
    hourly = kept(HOURLY, conform(
        facts.with_clients(counted.unionByName(stored(COUNTS, COUNTS_SCHEMA, affected - changed)), *dims), SCHEMAS[HOURLY]
    ))
    daily = kept(DAILY, conform(facts.daily_from_hours(hourly), SCHEMAS[DAILY]))
    old = stored(HOURLY, SCHEMAS[HOURLY], affected)
    kept("totals", weekday.replaced_totals(state.totals(), facts.timed_cases(old), facts.timed_cases(hourly)).select(
        "client_id", "weekday", "bucket", F.col("cases").cast("long"), F.col("days").cast("long")
    ))
    last = cases.filter(F.col("source") == "studies").agg(F.max("day")).first()[0] or since
    if first_run:
        ring = rolling.window_state(daily, through=last)
    else:
        last = max(last, state.through)
        ring = rolling.advanced(state.ring(), daily, through=state.through, to=last, replaced=affected)
    kept("ring", ring)

    before = state.content.get("folder")
    state.commit(
        kind="prepared", folder=folder, first=first_run, since=since.isoformat(), through=last.isoformat(),
        changed=sorted(day.isoformat() for day in changed), affected=sorted(day.isoformat() for day in affected),
    )
    state.finish()
    if before:
        remove_folder(spark, f"{out}/{before}")
    return sorted(affected)
