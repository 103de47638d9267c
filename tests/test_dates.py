import random
from datetime import date, datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

from mergetide.functions.dates import calendar_age_days, day_bin, elapsed_days, iso_utc, timestamp_lit, week_bin
from mergetide.functions.ranges import bin_unit, preset_range, resolve_range, to_utc
from mergetide.operators.calendar import with_days
from tests.helpers import ts

PAIR = "later timestamp_ntz, earlier timestamp_ntz"


def ages(spark, pairs):
    df = spark.createDataFrame(pairs, PAIR)
    return [r[0] for r in df.select(calendar_age_days("later", "earlier")).collect()]


@pytest.mark.parametrize(
    "later,earlier,days",
    [
        ("2024-03-01", "2024-01-31", 31.0),
        ("2024-03-31", "2024-02-29", 32.0),
        ("2025-03-01 01:00:00.5", "2024-02-29", 366.291672),
        ("2024-01-01", "2024-03-05", -64.0),
        ("2022-03-09 10:45:30", "2022-03-07 08:15:00", 2.104514),
        ("2024-01-01", "2024-01-01", 0.0),
        ("2024-01-02 00:00:00", "2024-01-01 23:59:59", 1 / 86400),
        (None, "2024-01-01", None),
        ("2024-01-01", None, None),
    ],
)
def test_age_cases(spark, later, earlier, days):
    (age,) = ages(spark, [(ts(later), ts(earlier))])
    assert age is None if days is None else age == pytest.approx(days, abs=1e-6)


def test_age_agrees_with_duckdb(spark):
    rng = random.Random(7)
    start = datetime(1990, 1, 1)
    pairs = []
    for _ in range(20_000):
        a = start + timedelta(days=rng.randrange(14_000), seconds=rng.randrange(86_400), microseconds=rng.randrange(10**6))
        near = rng.random() < 0.5
        b = a + timedelta(days=rng.randrange(-70, 70)) if near else start + timedelta(days=rng.randrange(14_000))
        pairs.append((a, b))
    connection = duckdb.connect()
    connection.execute("create table pairs (i int, a timestamp, b timestamp)")
    import pandas as pd

    frame = pd.DataFrame({"i": range(len(pairs)), "a": [p[0] for p in pairs], "b": [p[1] for p in pairs]})
    connection.register("frame", frame)
    expected = connection.sql("select epoch(age(a, b)) / 86400 from frame order by i").fetchall()
    assert ages(spark, pairs) == pytest.approx([e[0] for e in expected], abs=1e-6)


def test_elapsed(spark):
    df = spark.createDataFrame([(ts("2024-03-31"), ts("2024-02-29"))], PAIR)
    assert df.select(elapsed_days("later", "earlier")).first()[0] == 31.0


def test_bins(spark):
    days = [(ts("2024-01-06 23:59:59"),), (ts("2024-01-07"),), (ts("2024-01-08"),)]
    df = spark.createDataFrame(days, "t timestamp_ntz")
    assert [r[0] for r in df.select(week_bin("t")).collect()] == [date(2023, 12, 31), date(2024, 1, 7), date(2024, 1, 7)]
    assert [r[0] for r in df.select(day_bin("t")).collect()] == [date(2024, 1, 6), date(2024, 1, 7), date(2024, 1, 8)]
    assert df.select(iso_utc("t")).first()[0] == "2024-01-06T23:59:59Z"


@pytest.mark.parametrize(
    "start,end,days",
    [
        ("2024-01-01 10:00:00", "2024-01-03 09:00:00", ["2024-01-01", "2024-01-02"]),
        ("2024-01-01", "2024-01-03", ["2024-01-01", "2024-01-02", "2024-01-03"]),
        ("2024-01-03", "2024-01-01", []),
        ("2024-01-01", "2024-01-01", ["2024-01-01"]),
    ],
)
def test_calendar(spark, start, end, days):
    one = spark.range(1)
    found = with_days(one, timestamp_lit(start), timestamp_lit(end)).select(F.col("day").cast("string"))
    assert [r[0] for r in found.collect()] == days


def test_calendar_without_bounds(spark):
    df = spark.createDataFrame([(None, ts("2024-01-01"))], "a timestamp_ntz, b timestamp_ntz")
    assert with_days(df, F.col("a"), F.col("b")).count() == 0


NOW = datetime(2024, 3, 15, 17, 30, tzinfo=timezone.utc)


def test_ranges():
    today = datetime(2024, 3, 15)
    assert resolve_range(NOW) == (datetime(2024, 2, 14), today)
    assert resolve_range(NOW, "2024-01-01T00:00:00+02:00", "2024-01-05T00:00:00Z") == (
        datetime(2023, 12, 31, 22),
        datetime(2024, 1, 5),
    )
    assert resolve_range(NOW, end="2024-01-31T00:00:00Z") == (datetime(2024, 1, 1), datetime(2024, 1, 31))
    for preset, days in [("last_seven", 7), ("last_thirty", 30), ("last_ninety", 90), ("last_three_sixty_five", 365)]:
        assert preset_range(preset, NOW) == (today - timedelta(days=days), today)
    assert preset_range("who knows", NOW) == preset_range("last_thirty", NOW)
    assert preset_range("absolute", NOW, start="2024-02-01") == (datetime(2024, 2, 1), today)
    assert to_utc("2024-01-01T00:00:00-05:00") == datetime(2024, 1, 1, 5)
    # A clock in another zone: still the UTC day.
    late = datetime(2024, 3, 15, 23, 0, tzinfo=timezone(timedelta(hours=-3)))
    assert preset_range("last_seven", late)[1] == datetime(2024, 3, 16)


def test_bin_unit():
    start = datetime(2024, 1, 1)
    assert bin_unit(start, start + timedelta(days=70)) == "day"
    assert bin_unit(start, start + timedelta(days=70, seconds=1)) == "week"
    assert bin_unit(start + timedelta(days=71), start) == "week"


@pytest.mark.parametrize(
    "value,expected",
    [
        (NOW, "2024-03-15 17:30:00"),
        (datetime(2024, 3, 15, 17, 30), "2024-03-15 17:30:00"),
        ("2024-03-15T17:30:00+02:00", "2024-03-15 15:30:00"),
        ("2024-03-15T17:30:00.25Z", "2024-03-15 17:30:00.25"),
        (date(2024, 3, 15), "2024-03-15 00:00:00"),
        ("2024-03-15", "2024-03-15 00:00:00"),
    ],
)
def test_literals(spark, value, expected):
    assert spark.range(1).select(timestamp_lit(value).cast("string")).first()[0] == expected
