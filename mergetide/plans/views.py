"""Names for ad hoc SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mergetide.plans.metrics import latest_pulls, pulls_from_raw


def register_views(
    spark: SparkSession, raw: DataFrame, pulls: DataFrame | None = None, prefix: str = ""
) -> dict[str, DataFrame]:
    """Temporary views ``raw_payload``, ``pulls`` and ``pulls_latest`` for ``spark.sql``.

    Without a ``pulls`` table the raw pages are shredded by each query that needs them.
    """
    pulls = pulls_from_raw(raw) if pulls is None else pulls
    views = {"raw_payload": raw, "pulls": pulls, "pulls_latest": latest_pulls(pulls)}
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return views
