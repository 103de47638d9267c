"""Dense calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_days(df: DataFrame, start: Column, end: Column, day: str = "day") -> DataFrame:
    """Each row once per day of ``start``..``end``, both inclusive; none if ``end`` comes first.

    Steps are whole days from ``start``: if that is no midnight, a last day of
    less than 24 hours is left out. Row-wise, so no join and no shuffle.
    """
    steps = F.when(end >= start, F.sequence(start, end, F.expr("interval 1 day")))
    return df.withColumn("_step", F.explode(steps)).withColumn(day, F.col("_step").cast("date")).drop("_step")
