"""Latest version per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The row of each key that is greatest in ``newest`` (compared left to right, NULL lowest).

    NULL keys form a group of their own. Spark cuts every partition down to one
    row per key before the shuffle (window group limit), so the shuffle carries
    at most one version per key and map task, and a hot key is no hot task.
    As a window, unread columns are pruned all the way down to the scan.
    """
    order = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in newest])
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
