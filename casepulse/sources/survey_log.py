"""The survey log with atomic appends, ids without a scan, and a snapshot of last entries.

Entries are Parquet folders that nobody sees before a commit names them. A commit also holds the
ranges of ids and days of its entries, so the next id comes from the last commit and a read of
some days opens only their folders. An append that loses its number to another run decides and
numbers anew on the log as it then is.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casepulse.operators.survey import last_entries, new_entries, with_created_id
from casepulse.schemas import SCHEMAS
from casepulse.sources.commits import Commits
from casepulse.sources.readers import conform
from casepulse.sources.writers import remove_folder, stage

SCHEMA = SCHEMAS["client_survey"]
LAST_SCHEMA = "contact_fk long, last_created_at timestamp_ntz"


class SurveyLog:
    """A survey log below a folder; days of a plain log that stands there already are its oldest part."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.commits = Commits(spark, f"{self.path}/commits")

    def head(self) -> dict[str, Any]:
        """The log's present version: its number, last id, parts (with ranges of days and ids) and snapshot."""
        return self.commits.last() or self._plain()

    def _plain(self) -> dict[str, Any]:
        """Version 0. A plain log is read as a whole this once, for its largest id."""
        rows, first, last, start, end = self._ranges(self._plain_entries())
        part = {"folder": "", "rows": rows, "ids": [first, last], "days": [start, end]}
        return {"number": 0, "last_id": max(last or 0, 0), "parts": [part] if rows else [], "snapshot": None}

    def _plain_entries(self) -> DataFrame:
        try:
            days = self.spark.read.option("basePath", self.path).parquet(f"{self.path}/created_date=*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMA)
        return conform(days, SCHEMA)

    @staticmethod
    def _ranges(entries: DataFrame) -> tuple:
        day = F.to_date("created_at").cast("string")
        return tuple(entries.agg(F.count(F.lit(1)), F.min("id"), F.max("id"), F.min(day), F.max(day)).first())

    def read(self, since: dt.date | None = None, head: dict[str, Any] | None = None, after: int = 0) -> DataFrame:
        """The entries, or those from a day on; of a version; of the parts after the first so many."""
        parts = (head or self.head())["parts"][after:]
        if since is not None:
            parts = [part for part in parts if part["days"][1] >= since.isoformat()]
        folders = [f"{self.path}/{part['folder']}" for part in parts if part["folder"]]
        frames = [self.spark.read.schema(SCHEMA).parquet(*folders)] if folders else []
        frames += [self._plain_entries()] if len(folders) < len(parts) else []
        frames = frames or [self.spark.createDataFrame([], SCHEMA)]
        log = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
        return log if since is None else log.filter(F.col("created_at") >= F.lit(since))

    def _commit(self, head: dict[str, Any], entries: DataFrame) -> bool:
        """Writes the entries and makes them the next version; False, with nothing left, if another run was first."""
        folder = f"data/{uuid.uuid4().hex}"
        conform(entries, SCHEMA).write.parquet(f"{self.path}/{folder}")
        rows, first, last, start, end = self._ranges(self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{folder}"))
        part = {"folder": folder, "rows": rows, "ids": [first, last], "days": [start, end]}
        new = {"last_id": max(head["last_id"], last or 0), "parts": [*head["parts"], *([part] if rows else [])], "snapshot": head["snapshot"]}
        made = bool(rows) and self.commits.create(head["number"] + 1, new)
        if not made:
            remove_folder(self.spark, f"{self.path}/{folder}")
        return made or not rows

    def adopt(self, entries: DataFrame) -> None:
        """Appends entries that have their ids, as from another log."""
        while not self._commit(self.head(), entries):
            pass

    def append(self, decide: Callable[[DataFrame], DataFrame], *, as_of_ts: dt.datetime, reach: dt.timedelta) -> DataFrame:
        """Appends what ``decide`` makes of the log's entries of the last ``reach``, and returns it with ids, staged.

        Ids go on without gaps from the log's last one. Entries that an earlier attempt of the same
        run (the same as-of time) has committed keep their ids and are not appended again. When another run
        commits in between, everything is decided again on the log with its entries.
        """
        while True:
            head = self.head()
            entries = stage(self.spark, decide(self.read((as_of_ts - reach).date(), head)), "entries")
            today = self.read(as_of_ts.date(), head)
            created = stage(self.spark, with_created_id(
                entries, today, as_of_ts=as_of_ts, last_id=head["last_id"]
            ), "survey")
            if self._commit(head, new_entries(created, today, as_of_ts=as_of_ts)):
                return created

    def compact(self) -> None:
        """Stores each contact's last entry as of now; later ones are read besides it.

        Reads the snapshot before it and the entries since, not the log. Leaves the entries as they are.
        """
        while True:
            head, folder = self.head(), f"snapshots/{uuid.uuid4().hex}"
            if not head["parts"]:
                return
            self.last_entries(head).write.parquet(f"{self.path}/{folder}")
            content = {name: head[name] for name in ("last_id", "parts")} | {
                "snapshot": {"folder": folder, "parts": len(head["parts"])}
            }
            if self.commits.create(head["number"] + 1, content):
                return
            remove_folder(self.spark, f"{self.path}/{folder}")

    def last_entries(self, head: dict[str, Any] | None = None) -> DataFrame:
        """Time of each contact's last entry: the snapshot's, or a later one of the parts since."""
        head = head or self.head()
        snapshot = head["snapshot"]
        if not snapshot:
            return last_entries(self.read(head=head))
        base = self.spark.read.schema(LAST_SCHEMA).parquet(f"{self.path}/{snapshot['folder']}")
        if snapshot["parts"] == len(head["parts"]):
            return base
        since = last_entries(self.read(head=head, after=snapshot["parts"]))
        return base.unionByName(since).groupBy("contact_fk").agg(F.max("last_created_at").alias("last_created_at"))


def read_survey_log(spark: SparkSession, path: str, since: dt.date | None = None) -> DataFrame:
    """The log's entries, or those from a day on, whether it has commits or is a plain one."""
    return SurveyLog(spark, path).read(since)
