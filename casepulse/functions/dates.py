"""Calendar expressions around an explicit as-of day. No function reads the clock."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Positions that one BIGINT holds as bits; any number of words makes any number of positions.
WORD = 63


def days(n: int) -> dt.timedelta:
    return dt.timedelta(days=n)


def monday_of(day: dt.date) -> dt.date:
    return day - days(day.weekday())


def parse_date(value: Column) -> Column:
    """Strict parse: malformed text is an error."""
    return F.to_date(value)


def parse_timestamp_or_null(value: Column) -> Column:
    """Lenient parse: malformed text becomes NULL."""
    return F.try_to_timestamp(value)


def same_weekday_dates(as_of: dt.date, weeks: int) -> list[dt.date]:
    """as_of and the same weekday of the ``weeks`` weeks before it, newest first."""
    return [as_of - days(7 * k) for k in range(weeks + 1)]


def day_ranges(given: Iterable[dt.date]) -> list[tuple[dt.date, dt.date]]:
    """Days as ranges without gaps, both ends included."""
    out: list[tuple[dt.date, dt.date]] = []
    for day in sorted(set(given)):
        if out and day - out[-1][1] == days(1):
            out[-1] = out[-1][0], day
        else:
            out.append((day, day))
    return out


def on_days(column: str, given: Iterable[dt.date], *, time: bool = False) -> Column:
    """Whether a date, or a zone-less ``time``, is on one of some days: as ranges, which a scan can use."""
    def at(day: dt.date) -> Column:
        return F.lit(day).cast("timestamp_ntz") if time else F.lit(day)

    ranges = ((F.col(column) >= at(a)) & (F.col(column) < at(z + days(1))) for a, z in day_ranges(given))
    return reduce(or_, ranges, F.lit(False))


def words(position: Column, size: int) -> Column:
    """Aggregate: an array of BIGINTs with a bit for each position in 0..size-1 that occurs.

    A few BIGINTs per group combine on the map side, so unlike a distinct count they need no
    second exchange and a hot key shuffles one row per map task. Other positions do not count.
    """
    return F.array(*(
        F.bit_or(F.when(
            position.between(first, min(first + WORD, size) - 1),
            F.call_function("shiftleft", F.lit(1).cast("long"), (position - first).cast("int")),
        ))
        for first in range(0, size, WORD)
    ))


def merged_words(array: str, size: int) -> Column:
    """Aggregate: the words of several groups as one."""
    return F.array(*(F.bit_or(F.get(array, F.lit(k))) for k in range(-(-size // WORD))))


def positions_in(array: Column) -> Column:
    """How many positions occur in words."""
    ones = F.transform(array, lambda word: F.coalesce(F.bit_count(word), F.lit(0)))
    return F.aggregate(ones, F.lit(0).cast("long"), lambda total, n: total + n)


def distinct_positions(position: Column, size: int) -> Column:
    """Aggregate: how many different positions in 0..size-1 occur."""
    return positions_in(words(position, size))


def window_length(start: dt.date, end: dt.date) -> int:
    return (end - start).days + 1


def day_words(date: Column, start: dt.date, end: dt.date) -> Column:
    """Aggregate: words with a bit for each day of [start, end] that occurs."""
    return words(F.datediff(date, F.lit(start)), window_length(start, end))


def distinct_days(date: Column, start: dt.date, end: dt.date) -> Column:
    """Aggregate: number of different days within [start, end]; other days do not count."""
    return positions_in(day_words(date, start, end))


def weekday_name(date: Column) -> Column:
    return F.date_format(date, "EEEE")


def weekday_label(weekday: Column) -> Column:
    """Name of a weekday number, Monday = 0."""
    # 1970-01-05 was a Monday.
    return weekday_name(F.date_add(F.lit(dt.date(1970, 1, 5)), weekday))


def interval_label(bucket: Column, hours: int = 4) -> Column:
    """``08:00 - 12:00`` for bucket 2 of the ``hours``-long parts of a day."""
    start = bucket * F.lit(hours)
    return F.format_string("%02d:00 - %02d:00", start, start + F.lit(hours))
