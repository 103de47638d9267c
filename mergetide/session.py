"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Naive UTC timestamps everywhere, and errors rather than silent NULLs.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}
# Runtime re-planning: coalesces small shuffles, splits skewed join partitions.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
# Folders are listed by so many tasks at most, many in each: one task for each folder takes longer to start than to list.
LISTING = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "100"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session someone else created."""
    for key, value in {**REQUIRED, **ADAPTIVE, **LISTING}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


# Call-site capture on every column function doubles the time it takes to build a plan.
STARTUP = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app: str = "mergetide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED, **ADAPTIVE, **LISTING, **STARTUP}.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def require_utc(spark: SparkSession) -> None:
    """Naive timestamps become instants on the way to microseconds; only UTC keeps them apart evenly."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, not {zone}: call configure(spark)")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder all executors can reach, under the cluster's checkpoint folder.

    Only where the cluster names none, and all runs on one machine, is a local one made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix="mergetide-")
    return f"{root.rstrip('/')}/mergetide-{uuid.uuid4()}"
