from __future__ import annotations

import datetime as dt
import json
from urllib.parse import parse_qs

import pytest
from pyspark.sql import functions as F

from casepulse.functions import dates, numbers, payload, text


def values(spark, column, rows, schema="v string"):
    df = spark.createDataFrame([(row,) if not isinstance(row, tuple) else row for row in rows], schema)
    return [row[0] for row in df.select(column).collect()]


def test_percentages_without_a_baseline_are_null_not_an_error(spark):
    pairs = [(5, 0), (0, 0), (None, 4), (3, None), (6, 4)]
    got = values(spark, numbers.pct_diff("a", "b"), pairs, "a long, b long")
    assert got == [None, None, None, None, 50.0]
    got = values(spark, numbers.guarded_pct("a", "b"), pairs, "a long, b long")
    assert got == [0.0, 0.0, None, 0.0, 150.0]


def test_rounding_is_half_even(spark):
    got = values(spark, numbers.round_pct(F.col("v")), [0.125, 0.375, -0.125, 2.5, None], "v double")
    assert got == [0.12, 0.38, -0.12, 2.5, None]


def test_percent_text_equals_python_formatting_for_all_small_ratios(spark):
    pairs = [(a, b) for b in range(1, 130) for a in range(0, b + 1)]
    share = numbers.guarded_pct("a", "b")
    got = values(spark, numbers.format_pct(share), pairs, "a long, b long")
    assert got == [f"{a / b * 100:.2f}%" for a, b in pairs]


@pytest.mark.parametrize("number, shown", [(2.675, "2.67%"), (0.125, "0.12%"), (1.005, "1.00%"), (1234567.891, "1234567.89%")])
def test_percent_text_rounds_the_binary_value(spark, number, shown):
    assert values(spark, numbers.format_pct(F.col("v")), [number], "v double") == [shown]


@pytest.mark.parametrize(
    "phone, cleaned, valid",
    [
        ("+91-9876543210", "919876543210", True),
        ("91-9876543210", "919876543210", True),
        ("9876543210", "919876543210", True),
        ("987654321", "987654321", False),
        ("98765432101", "98765432101", False),
        ("+91-9891-12345", "9812345", False),
        ("", "", False),
        ("٠١٢٣٤٥٦٧٨٩", "٠١٢٣٤٥٦٧٨٩", False),
        (None, None, None),
    ],
)
def test_phone(spark, phone, cleaned, valid):
    assert values(spark, text.clean_phone(F.col("v")), [phone]) == [cleaned]
    local = text.is_local_phone(text.strip_country_code(F.col("v")))
    assert values(spark, local, [phone]) == [valid]


RULES = [
    ('[{"list":["XRAY","CHEST PA"]},{"list":["CT"]}]', "XRAY", "XRAY CHEST PA,CT"),
    ('{"list":["MRI"]}', "MRI", "MRI"),
    ('[{"list":["A, B","C"]}]', "A, B", "A  B C"),
    ('[{"id":1},{"list":["CT"]}]', "CT", ",CT"),
    ('[{"list":[]}]', "", ""),
    ("[{}]", "", ""),
    ("[]", "", ""),
    ("bad", "", ""),
    ("", "", ""),
    (None, "", ""),
]


@pytest.mark.parametrize("rules, first, name", RULES)
def test_fields_of_the_rules(spark, rules, first, name):
    assert values(spark, text.modality(F.col("v")), [rules]) == [first]
    assert values(spark, text.study_name(F.col("v")), [rules]) == [name]


@pytest.mark.parametrize("rules, first", [
    ('[{"list":null},{"list":["CT"]}]', ""),
    ('[{"list":"MRI"},{"list":["CT"]}]', ""),
    ('[{"list":[]},{"list":["CT"]}]', ""),
    ('[{"list" : [ {"name":"MR"}, "CT"]}]', "{name:MR}"),
    ('[{"list":[null,"CT"]}]', "null"),
    ('[{"list":[7]}]', "7"),
])
def test_the_first_list_counts_as_it_stands(spark, rules, first):
    assert values(spark, text.modality(F.col("v")), [rules]) == [first]


def test_backslashes(spark):
    once, twice = r'[{\"list\":[\"CT\"]}]', r'[{\\"list\\":[\\"CT\\"]}]'
    assert values(spark, text.modality(F.col("v"), "single"), [once, twice]) == ["CT", "CT"]
    assert values(spark, text.modality(F.col("v"), "double"), [once, twice]) == ["", "CT"]


def test_na_and_list_marks(spark):
    assert values(spark, text.null_na(F.col("v")), ["NA", "", None, "1"]) == [None, "", None, "1"]
    assert values(spark, text.has_text(F.col("v")), ["x", "", None]) == [True, False, False]
    assert values(spark, text.strip_list_marks(F.col("v")), ['["A","B"]', None]) == ["A,B", None]


def test_lenient_and_strict_dates(spark):
    got = values(spark, dates.parse_timestamp_or_null(F.col("v")), ["2024-01-02 03:04:05", "soon", None])
    assert [value and value.hour for value in got] == [3, None, None]
    assert values(spark, dates.parse_date(F.col("v")), ["2024-01-02"]) == [dt.date(2024, 1, 2)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        values(spark, dates.parse_date(F.col("v")), ["soon"])


def test_weekdays_and_intervals(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=n) for n in range(7)]
    assert values(spark, dates.weekday_name(F.col("v")), days, "v date") == [d.strftime("%A") for d in days]
    assert values(spark, dates.weekday_label(F.weekday("v")), days, "v date") == [d.strftime("%A") for d in days]
    assert values(spark, dates.interval_label(F.col("v")), [0, 2, 5], "v int") == [
        "00:00 - 04:00", "08:00 - 12:00", "20:00 - 24:00",
    ]
    assert dates.monday_of(dt.date(2024, 1, 7)) == dt.date(2024, 1, 1) == dates.monday_of(dt.date(2024, 1, 1))


@pytest.mark.parametrize("span", [1, 30, 63, 64, 90, 200, 400])
def test_distinct_days_for_short_and_long_windows(spark, span):
    start = dt.date(2024, 1, 1)
    end = start + dt.timedelta(days=span - 1)
    picked = [start, end, end, start + dt.timedelta(days=span // 2), start - dt.timedelta(days=1),
              end + dt.timedelta(days=1), None]
    df = spark.createDataFrame([(1, day) for day in picked] + [(2, None)], "k int, d date")
    got = df.groupBy("k").agg(dates.distinct_days(F.col("d"), start, end).alias("n")).orderBy("k").collect()
    inside = {day for day in picked if day and start <= day <= end}
    assert [row.n for row in got] == [len(inside), 0]


def test_form_and_template(spark):
    template = payload.template_json("t-1", F.array(F.lit("60"), F.lit("66.67%")))
    body = payload.form_encode([("channel", F.lit("whatsapp")), ("src.name", F.lit("a b&c")), ("template", template)])
    got = parse_qs(spark.range(1).select(body.alias("body")).first().body)
    assert got["src.name"] == ["a b&c"]
    assert json.loads(got["template"][0]) == {"id": "t-1", "params": ["60", "66.67%"]}


def test_recipients(spark):
    made = payload.recipients(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"), F.lit("a")))
    got = spark.range(1).select(made.alias("r")).first().r
    assert [tuple(entry) for entry in got] == [("a", "to"), ("b", "to"), ("c", "cc"), ("a", "to")]


@pytest.mark.parametrize(
    "response, status, code",
    [
        ('{"status":"queued"}', "queued", 202),
        ('{"status":"sent"}', "sent", 202),
        ('{"status":"rejected"}', "rejected", 500),
        ('{"other":1}', payload.NO_STATUS, 500),
        ("<html>", payload.NOT_JSON, 500),
        (None, payload.NOT_JSON, 500),
    ],
)
def test_delivery_answer(spark, response, status, code):
    assert values(spark, payload.response_status(F.col("v")), [response]) == [status]
    assert values(spark, payload.status_code(payload.response_status(F.col("v"))), [response]) == [code]


def test_link(spark):
    assert values(spark, payload.feedback_link("https://example.org/?id=", F.col("v")), [7], "v long") == [
        "https://example.org/?id=7"
    ]
