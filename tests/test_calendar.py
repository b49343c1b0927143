import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabforge.functions import calendar as cal


def one(spark, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df


def ask(spark, text, fn):
    return spark.range(1).select(F.lit(text).cast("date").alias("d")).select(fn("d").alias("x")).first()["x"]


@pytest.mark.parametrize("day", ["2000-04-23", "2019-04-21", "2024-03-31", "2025-04-20", "2026-04-05", "2038-04-25"])
def test_easter(spark, day):
    assert spark.range(1).select(cal.easter(F.lit(int(day[:4]))).alias("e")).first().e == dt.date.fromisoformat(day)


def test_rdate_round_trip(spark):
    days = spark.range(-800_000, 60_000, 97).select(F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    days = days.filter("d >= '0001-01-01'")
    assert days.filter(cal.rdate_to_date(cal.to_rdate("d")) != F.col("d")).isEmpty()
    assert days.filter(cal.day_of_week("d") != F.pmod(cal.to_rdate("d"), F.lit(7))).isEmpty()
    assert ask(spark, "0001-01-01", cal.to_rdate) == 1


def test_kday_bounds(spark):
    days = spark.range(0, 900).select(F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    for k in range(7):
        gaps = days.select(*[F.datediff(f("d", k), "d").alias(n) for n, f in {
            "ob": cal.kday_on_before, "oa": cal.kday_on_after, "b": cal.kday_before, "a": cal.kday_after, "n": cal.kday_nearest}.items()],
            (cal.day_of_week(cal.kday_nearest("d", k)) == k).alias("right"))
        low_high = gaps.agg(*[F.min(c).alias(f"lo_{c}") for c in ("ob", "oa", "b", "a", "n")], *[F.max(c).alias(f"hi_{c}") for c in ("ob", "oa", "b", "a", "n")], F.bool_and("right").alias("right")).first()
        assert low_high.right
        assert (low_high.lo_ob, low_high.hi_ob) == (-6, 0) and (low_high.lo_oa, low_high.hi_oa) == (0, 6)
        assert (low_high.lo_b, low_high.hi_b) == (-7, -1) and (low_high.lo_a, low_high.hi_a) == (1, 7)
        assert (low_high.lo_n, low_high.hi_n) == (-3, 3)


@pytest.mark.parametrize("text,ok", [
    ("2023-01-01", True), ("2023-12-31", True), ("2024-02-29", True), ("2016-7-1", True), ("2023-13-01", False),
    ("2023-01-32", False), ("not-a-date", False), ("", False), ("2023/01/01", False), (None, False)])
def test_valid_date(spark, text, ok):
    assert spark.range(1).select(cal.valid_date(F.lit(text).cast("string")).alias("v")).first().v is ok


@pytest.mark.parametrize("day,n,want", [("2023-01-10", 5, "2023-01-05"), ("2023-01-01", 1, "2022-12-31")])
def test_subtract_days(spark, day, n, want):
    assert ask(spark, day, lambda d: cal.subtract_days(d, n)) == dt.date.fromisoformat(want)


def test_third_fridays(spark):
    events = spark.range(1).select(cal.monthly_events(3, 5, F.lit(2024)).alias("e")).first().e
    assert events[0] == dt.date(2024, 1, 19) and events[11] == dt.date(2024, 12, 20) and len(events) == 12


def test_business_days(spark):
    # July 2024: the 4th is a Thursday and closed
    assert ask(spark, "2024-07-05", cal.biz_day_month) == 4
    assert ask(spark, "2024-07-05", cal.biz_day_week) == 4
    assert ask(spark, "2024-07-05", lambda d: cal.biz_day_week(d, parity=True)) == -1
    assert ask(spark, "2024-07-06", cal.biz_day_week) == 0
    assert spark.range(1).select(cal.nth_bizday(4, F.lit(2024), F.lit(7)).alias("d")).first().d == dt.date(2024, 7, 5)


def test_holidays(spark):
    row = {r.name: r.holiday for r in cal.holiday_table(spark.range(1).select(F.lit(2021).alias("year"))).collect()}
    assert len(row) == 17 and list(cal.holiday_names())[0] == "New Year's Day"
    assert row["Independence Day"] == dt.date(2021, 7, 5)  # Sunday, observed on Monday
    assert row["Christmas"] == dt.date(2021, 12, 24)  # Saturday, observed on Friday
    assert row["Thanksgiving"] == dt.date(2021, 11, 25) and row["Memorial Day"] == dt.date(2021, 5, 31)
    plain = {r.name: r.holiday for r in cal.holiday_table(spark.range(1).select(F.lit(2021).alias("year")), observed=False).collect()}
    assert plain["Christmas"] == dt.date(2021, 12, 25)


def test_nearest_events_with_ties_and_gaps(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-05"), (3, "2024-02-01"), (4, None)], "k int, d string").withColumn("d", F.to_date("d"))
    ev = spark.createDataFrame([("2024-01-05",), ("2024-01-05",), ("2024-01-20",)], "e string").withColumn("e", F.to_date("e"))
    out = {r.k: (r.previous_event, r.next_event) for r in cal.with_nearest_events(df, "d", ev, "e").collect()}
    a, b = dt.date(2024, 1, 5), dt.date(2024, 1, 20)
    assert out == {1: (None, a), 2: (None, b), 3: (b, None), 4: (None, None)}


def test_timeparts_of_bad_text(spark):
    df = spark.createDataFrame([("09:08:07",), ("nope",)], "t string").select(*[v.alias(k) for k, v in cal.timeparts("t").items()])
    assert [tuple(r) for r in df.collect()] == [(9, 8, 7), (None, None, None)]
