"""Date arithmetic on naive UTC timestamps, as Catalyst expressions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergetide.functions.ranges import to_utc

DAY_US = 86_400_000_000
# An age counts 30-day months and 365.25-day years.
AGE_MONTH_US = 30 * DAY_US
AGE_YEAR_US = 31_557_600_000_000


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def timestamp_lit(value: datetime | date | str) -> Column:
    """A naive UTC timestamp literal; a value with an offset is converted."""
    if isinstance(value, date) and not isinstance(value, datetime):
        value = value.isoformat()
    return F.lit(to_utc(value).isoformat(sep=" ")).cast("timestamp_ntz")


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a date or naive timestamp (session time zone UTC)."""
    return F.unix_micros(_col(ts).cast("timestamp_ntz").cast("timestamp"))


def order_key(df: DataFrame, column: str) -> Column:
    """A long that orders like ``column``: microseconds for times, the value itself for integers."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return micros(column)
    if kind in ("long", "integer", "short", "byte"):
        return F.col(column).cast("long")
    raise TypeError(f"{column} is {kind}; a time or an integer is needed")


def calendar_age_us(later: str, earlier: str) -> Column:
    """Calendar age in microseconds: whole months first, then the days and time left over.

    Takes column names or SQL text. Months count 30 days and years 365.25, so the
    age is exact only within a month: 2024-02-29 to 2024-03-31 is 1 month and 2
    days, 32 days in all. Negative if ``later`` comes first, NULL from or to NULL.
    """
    low, high = f"least({later}, {earlier})", f"greatest({later}, {earlier})"

    def in_month(ts: str) -> str:
        """Microseconds since a month's start, but for one day that cancels out."""
        return f"(dayofmonth({ts}) * {DAY_US}L + pmod(unix_micros(cast({ts} as timestamp)), {DAY_US}L))"

    gap = f"({in_month(high)} - {in_month(low)})"
    # Short of a whole month: one month back, its length (that of the earlier one) forth.
    borrow = f"cast({gap} < 0 as int)"
    months = f"((year({high}) - year({low})) * 12 + month({high}) - month({low}) - {borrow})"
    size = f"""
        {months} * {AGE_MONTH_US}L + {months} div 12 * {AGE_YEAR_US - 12 * AGE_MONTH_US}L
        + {gap} + {borrow} * dayofmonth(last_day({low})) * {DAY_US}L"""
    # least() and greatest() skip NULLs, so they are ruled out.
    sign = f"case when {later} < {earlier} then -1 when {later} >= {earlier} then 1 end"
    return F.expr(f"{sign} * ({size})")


def calendar_age_days(later: str, earlier: str) -> Column:
    return calendar_age_us(later, earlier) / DAY_US


def elapsed_us(later: str | Column, earlier: str | Column) -> Column:
    """Real time between two instants, in microseconds."""
    return micros(later) - micros(earlier)


def elapsed_days(later: str | Column, earlier: str | Column) -> Column:
    return elapsed_us(later, earlier) / DAY_US


def day_bin(ts: str | Column) -> Column:
    return _col(ts).cast("date")


def week_bin(ts: str | Column) -> Column:
    """The Sunday that starts the week."""
    day = _col(ts).cast("date")
    return F.date_sub(day, F.dayofweek(day) - 1)


def iso_utc(ts: str | Column) -> Column:
    """``2024-01-31T10:00:00Z``"""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")
