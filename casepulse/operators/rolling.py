"""A window of days per client that moves on by the days that are new, and can take days back."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casepulse.functions.dates import days, on_days, window_length
from casepulse.operators.activity import DATE, check_disjoint, in_tiers
from casepulse.schemas import CHURN_TIERS, Tier

# Days that a ring holds: enough for a report as of any of the last four weeks.
RING = 64
SCHEMA = "client_fk long, ring array<struct<rows:long,counted:long,cases:long>>"


def _sums(daily: DataFrame, first: dt.date, given: Iterable[dt.date]) -> DataFrame:
    """client_fk and a map from places (days after ``first``) to sums, over some days: few entries per client."""
    per_day = (
        daily.dropna(subset=["client_fk"])
        .filter(on_days(DATE, given))
        .groupBy("client_fk", F.datediff(DATE, F.lit(first)).alias("place"))
        .agg(
            F.count(F.lit(1)).alias("rows"), F.count("total_case").alias("counted"),
            F.coalesce(F.sum("total_case"), F.lit(0)).alias("cases"),
        )
    )
    entry = F.struct("place", F.struct("rows", "counted", "cases"))
    return per_day.groupBy("client_fk").agg(F.map_from_entries(F.collect_list(entry)).alias("sums"))


def _empty_day() -> Column:
    zero = F.lit(0).cast("long")
    return F.struct(zero.alias("rows"), zero.alias("counted"), zero.alias("cases"))


def window_state(daily: DataFrame, *, through: dt.date, size: int = RING) -> DataFrame:
    """Each client's ring: fact rows, rows with a count, and cases of the ``size`` days that end with ``through``."""
    none = daily.sparkSession.createDataFrame([], SCHEMA)
    first = through - days(size - 1)
    return advanced(none, daily, through=first - days(1), to=through, size=size)


def advanced(
    state: DataFrame, daily: DataFrame, *, through: dt.date, to: dt.date, replaced: Iterable[dt.date] = (), size: int = RING
) -> DataFrame:
    """The rings through ``to``, from those through ``through``; days in ``replaced`` are taken back and read anew.

    Of the fact only the days after ``through`` and the replaced ones are read. A client's old days
    move to the front and fall out; a client without any case in its ring leaves the state.
    """
    shift, first = (to - through).days, to - days(size - 1)
    if shift < 0:
        raise ValueError(f"the state is through {through} already")
    fresh = {through + days(k) for k in range(1, shift + 1)} | set(replaced)
    places = sorted(p for p in ((day - first).days for day in fresh) if 0 <= p < size)
    news = _sums(daily, first, [first + days(p) for p in places])

    def day_of(place: Column) -> Column:
        old = F.get("ring", place + shift)
        new = F.try_element_at("sums", place)
        return F.coalesce(F.when(place.isin(places), new).otherwise(old), _empty_day())

    ring = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), day_of)
    joined = state.join(news, "client_fk", "full").select("client_fk", ring.alias("ring"))
    return joined.filter(F.exists("ring", lambda day: day["rows"] > 0))


class _Ring:
    """Sums over the days of a ring through a day."""

    def __init__(self, through: dt.date, size: int):
        self.first, self.through, self.size = through - days(size - 1), through, size

    def part(self, start: dt.date, end: dt.date) -> Column:
        """The ring's days from ``start`` to ``end``; days after its last have no cases yet."""
        if start < self.first:
            raise ValueError(f"{start} is before the ring's first day, {self.first}")
        end = min(end, self.through)
        return F.slice("ring", (start - self.first).days + 1, max(0, window_length(start, end)))

    def active_days(self, start: dt.date, end: dt.date) -> Column:
        return F.size(F.filter(self.part(start, end), lambda day: day["rows"] > 0)).cast("long")

    def mean(self, start: dt.date, end: dt.date) -> Column:
        def add(name: str) -> Column:
            return F.aggregate(self.part(start, end), F.lit(0).cast("long"), lambda total, day: total + day[name])

        return F.try_divide(add("cases").cast("double"), add("counted"))

    def last_seen(self, start: dt.date, end: dt.date) -> Column:
        seen = F.transform(self.part(start, end), lambda day, place: F.when(day["rows"] > 0, place))
        return F.date_add(F.lit(start), F.array_max(seen))


def client_activity(
    state: DataFrame, *, through: dt.date, as_of: dt.date, lag_days: int = 3, window_days: int = 30, size: int = RING
) -> DataFrame:
    """The activity report from rings: clients with a fact row in the window."""
    ring, end = _Ring(through, size), as_of - days(lag_days)
    start = end - days(window_days - 1)
    return state.select(
        "client_fk", ring.active_days(start, end).alias("active_days"), ring.mean(start, end).alias("avg_case_load")
    ).filter("active_days > 0")


def churn_tiers(
    state: DataFrame, *, through: dt.date, as_of: dt.date, tiers: Sequence[Tier] = CHURN_TIERS, min_avg_load: float = 5,
    lag_days: int = 3, window_days: int = 30, size: int = RING,
) -> DataFrame:
    """The churn tiers from rings, which must reach from the window's start; the fact is not read."""
    check_disjoint(tiers)
    ring, end, yesterday = _Ring(through, size), as_of - days(lag_days), as_of - days(1)
    start, reach = end - days(window_days - 1), as_of - days(max(tier.silent_days for tier in tiers))
    facts = state.select(
        "client_fk", ring.active_days(start, end).alias("active_days"), ring.mean(start, end).alias("avg_case_load"),
        ring.last_seen(reach, yesterday).alias("last_seen"),
    ).filter(F.col("avg_case_load") > min_avg_load)
    return in_tiers(facts, as_of=as_of, tiers=tiers)
