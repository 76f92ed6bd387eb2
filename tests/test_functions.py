"""Scalar functions by example."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsefield.functions import text as T
from pulsefield.functions.references import json_references


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "f,value,want",
    [
        (T.clean_text, "  a b ", "a b"), (T.clean_text, " N/A ", None), (T.clean_text, "na", None), (T.clean_text, None, None), (T.trimmed, "  ", None), (T.trimmed, " null ", "null"),
        (T.as_int, " 12.9 ", 12), (T.as_int, "x", 0), (T.as_int, None, 0), (T.as_float, "1.5", 1.5), (T.as_float, "", 0.0),
        (T.parse_bool, " Yes ", True), (T.parse_bool, "F", False), (T.parse_bool, "2", None),
        (T.phone_local, "+91 98765-43210", "9876543210"), (T.phone_local, "911234", "911234"), (T.phone_local, "none", None), (T.phone_local, "abc", None),
        (T.phone_international, "+44 20 7946 0958", "+442079460958"), (T.phone_international, "12-34", None), (T.phone_last10, "0091 98765 43210", "9876543210"), (T.phone_last10, "12", "12"), (T.phone_last10, None, ""),
        (T.email_loose, " A@b ", "a@b"), (T.email_loose, "ab", None), (T.email_strict, "A@b.c", "a@b.c"), (T.email_strict, "@b.c", None), (T.email_strict, "a@b", None),
        (T.identifier, " Ab-1 ", "ab1"), (T.identifier, "--", None), (T.campaign_dashless, "AB-1_c", "ab1_c"), (T.campaign_alnum, "AB-1_c", "ab1c"), (T.slug, " Héllo  World! ", "h-llo-world"), (T.slug, None, "unknown"), (T.slug, "--", "unknown"),
        (T.iso_datetime, "2024-01-05T10:11:12", "2024-01-05 10:11:12"), (T.iso_datetime, "2024-01-05 10:11:12.250000", "2024-01-05 10:11:12.250000"), (T.iso_date, "2024-02-30", None), (T.iso_date, "2024-01-05", "2024-01-05"), (T.iso_date, "05-01-2024", "2024-01-05"), (T.iso_datetime, "2024-01-05T10:11:12Z", "2024-01-05 10:11:12"),
        (T.course_state, "Course-Completed", "Completed"), (T.course_state, "in_progress", "In Progress"), (T.course_state, "odd", None), (T.course_state, None, None),
        (T.key_variants, "A-b c", ["a-b c", "abc", "a_b_c", "a-b-c"]),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize("day,end", [("2024-01-06", "2024-01-06"), ("2024-01-07", "2024-01-13"), ("2024-01-05", "2024-01-06")])
def test_weeks_end_on_saturday(spark, day, end):
    assert str(one(spark, dt.date.fromisoformat(day), T.saturday, "date")) == end


def test_bands_differ_at_40(spark):
    assert one(spark, 40.0, T.health_band, "double") == "red"
    assert one(spark, 40.0, lambda c: T.health_band(c, red_includes_40=False), "double") == "yellow"
    assert one(spark, 60.0, T.health_band, "double") == "green"


def test_health_is_capped_and_safe(spark):
    row = spark.createDataFrame([(10, 20, 0, 4.0), (0, 0, 0, 0.0)], "r int, o int, c int, b double").select(F.round(T.engagement_health(F.col("r"), F.col("o"), F.col("c"), F.col("b")), 3).alias("h"))
    assert [r.h for r in row.collect()] == [66.667, 0.0]


def test_follow_ups(spark):
    d = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(d, dt.date(2024, 1, 8), 7, 3, "Days"), (d, None, 7, 3, "weeks"), (None, None, 7, 2, "d")], "a date, b date, e int, n int, u string")
    got = [[(str(x.due), x.sequence, x.method) for x in r.f] for r in df.select(T.follow_ups([F.col("a"), F.col("b")], F.col("a"), F.col("e"), F.col("n"), F.col("u")).alias("f")).collect()]
    assert got[0] == [("2024-01-01", 1, "explicit"), ("2024-01-08", 2, "explicit"), ("2024-01-15", 3, "derived")]
    assert got[1] == [("2024-01-01", 1, "explicit")] and got[2] == []


def test_display_name_and_row_hash(spark):
    df = spark.createDataFrame([("", " A ", None, "x@y", None), (None, None, "na", None, None)], "f string, a string, b string, m string, p string")
    assert [r.n for r in df.select(T.display_name(*[F.col(c) for c in "fabmp"]).alias("n")).collect()] == ["A", "Unknown Doctor"]
    h = [r.h for r in df.select(T.row_hash(F.col("f"), F.col("p")).alias("h")).collect()]
    assert h[0] != h[1]


def test_iso_dates_and_formats(spark):
    texts = ["2024-01-05T10:11", "20240105", "2024-01-05T10:11:12Z", "20240105T1011", "2024-01-05 10", "2024-13-05", "05-01-2024", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [str(r[0]) for r in df.select(T.parse_datetime(F.col("t"), day_first=False)).collect()]
    assert got == ["2024-01-05 10:11:00", "2024-01-05 00:00:00", "2024-01-05 10:11:12", "2024-01-05 10:11:00", "2024-01-05 10:00:00", "None", "None", "None"]
    assert str(df.where("t = '05-01-2024'").select(T.parse_datetime(F.col("t"))).first()[0]) == "2024-01-05 00:00:00"
    numbers = spark.createDataFrame([("1234567",), ("1234.56",), ("x",), (None,)], "t string")
    assert [tuple(r) for r in numbers.select(T.format_number(F.col("t")), T.format_percent(F.col("t"))).collect()] == [("1,234,567", "1234567.0%"), ("1,234.6", "1234.6%"), ("0", "0.0%"), ("0", "0.0%")]
    dates = spark.createDataFrame([("2024-01-05", None), ("2024-01-05T10:00:00", "2024-02-01 00:00:00"), ("soon", ""), (None, None)], "a string, b string")
    assert [tuple(r) for r in dates.select(T.pretty_date(F.col("a")), T.reporting_window(F.col("a"), F.col("b"))).collect()] == [("Jan 05, 2024", "Jan 05, 2024"), ("Jan 05, 2024", "Jan 05, 2024 to Feb 01, 2024"), ("soon", "soon"), ("", "No dated activity yet")]


def test_json_references(spark):
    texts = ['{"Alpha": ["beta", "en", {"videos": 12345, "beta": null}], "abc": "video"}', "plain text", "", None, "[true, \'x\'"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(json_references(F.col("t"))).collect()] == [["Alpha", "beta", "12345"], ["plain text"], [], [], ["[true, \'x\'"]]
