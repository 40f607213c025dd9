"""Text cleaning and the fields held as JSON in a string column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RULES_SCHEMA = "array<struct<list:array<string>>>"

# Text up to the first "list", then, if that is an array, its first entry: a text, an object or a word.
FIRST_LIST_ENTRY = r'(?s)^.*?"list"\s*:\s*(?:\[\s*("[^"]*"|\{[^}]*\}|[^",\]\s]*))?'


def null_na(value: Column) -> Column:
    """'NA' means missing."""
    return F.nullif(value, F.lit("NA"))


def has_text(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def strip_list_marks(value: Column) -> Column:
    """Text of a JSON list without brackets and quotes."""
    return F.translate(value, '[]"', "")


def strip_country_code(phone: Column) -> Column:
    """Remove '+91-' and then '91-', wherever they occur."""
    return F.replace(F.replace(phone, F.lit("+91-"), F.lit("")), F.lit("91-"), F.lit(""))


def is_local_phone(stripped: Column) -> Column:
    return stripped.rlike("^[0-9]{10}$")


def clean_phone(phone: Column) -> Column:
    """Ten digits get the prefix 91; anything else stays as it is after stripping."""
    bare = strip_country_code(phone)
    return F.when(is_local_phone(bare), F.concat(F.lit("91"), bare)).otherwise(bare)


def _rules(rules: Column) -> Column:
    # PERMISSIVE parsing: malformed text is NULL, one object counts as a list of one.
    return F.from_json(F.coalesce(rules, F.lit("")), RULES_SCHEMA)


def unescape(rules: Column, mode: str) -> Column:
    """Drop every backslash ('single') or only doubled ones ('double')."""
    marks = {"single": "\\", "double": "\\\\"}
    return F.replace(rules, F.lit(marks[mode]), F.lit(""))


def modality(rules: Column, mode: str = "single") -> Column:
    """First entry of the first ``list`` in the rules, '' where that is empty, no list or missing.

    Later lists do not stand in for it. A pattern finds it in one pass over the text; parsing every study's JSON would dominate the
    scan.
    """
    entry = F.regexp_extract(unescape(rules, mode), FIRST_LIST_ENTRY, 1)
    return F.coalesce(F.replace(entry, F.lit('"'), F.lit("")), F.lit(""))


def study_name(rules: Column) -> Column:
    """Entries of each ``list`` joined by blanks, the lists joined by commas."""

    def words(rule: Column) -> Column:
        joined = F.array_join(F.coalesce(rule["list"], F.array().cast("array<string>")), " ")
        return F.replace(joined, F.lit(","), F.lit(" "))

    joined = F.array_join(F.transform(_rules(rules), words), ",")
    return F.coalesce(strip_list_marks(joined), F.lit(""))
