"""Merging the parts of a store, and the latest version of each pull request kept beside them.

A merge moves the rows of all batches since the last one into one part, in files of a
good size, and brings the table of latest versions up to date: cut by url into buckets, of
which only those with a url of these batches are written anew. Readers take each bucket
from the last merge that wrote it. Merges are numbered: of two
at once the slower one finds its number taken, and leaves no trace for readers.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergetide.operators.latest import latest_per_key
from mergetide.operators.repos import Repos, select_repos
from mergetide.schemas import LATEST
from mergetide.sources import commits
from mergetide.sources.tables import LAYOUT, PULLS_TABLE, Store, read_committed

LATEST_TABLE = "pulls_latest"
VERSION = ["updated_at", "raw_id", "item_pos"]


def _bucket(store: Store) -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(store.buckets)).cast("int")


def _base(spark: SparkSession, store: Store, seen: commits.Parts, only: list[int] | None = None) -> DataFrame:
    """The kept latest versions, or those of some buckets: each from the last merge that wrote it."""
    files, last = commits.Files(spark, store.home), {}
    there = set(files.names(LATEST_TABLE))
    for part in [p for p in seen.merged if f"part={p}" in there]:
        for name in files.names(f"{LATEST_TABLE}/part={part}"):
            last[int(name.partition("=")[2])] = f"{store.home}/{LATEST_TABLE}/part={part}/{name}"
    paths = [path for bucket, path in sorted(last.items()) if only is None or bucket in only]
    empty = spark.createDataFrame([], LATEST).limit(0)  # as in ``read_parts``
    if not paths:
        return empty
    return spark.read.schema(LATEST).parquet(*paths).select(*empty.columns)


def merge_batches(spark: SparkSession, store: Store) -> bool:
    """Merges the batches committed since the last merge. False if there were none, or somebody else was faster."""
    seen = commits.parts(spark, store.home)
    if not seen.batches:
        return False
    part = f"c{uuid.uuid4().hex}"
    for table, (_, partitions) in LAYOUT.items():
        rows = read_committed(spark, store, table, seen.batches)
        laid = rows.hint("rebalance", *partitions)
        if table == PULLS_TABLE:
            laid = laid.sortWithinPartitions("repo", "url")
        commits.write_part(laid, store.home, table, part, *partitions)

    fresh = read_committed(spark, store, PULLS_TABLE, [part]).withColumn("bucket", _bucket(store))
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # as many as there are buckets
    if touched:
        old = _base(spark, store, seen, touched).drop("shared").withColumn("bucket", _bucket(store))
        newest = latest_per_key(old.unionByName(fresh), ["url", "repo"], VERSION)
        shared = F.count("*").over(Window.partitionBy("url")) > 1
        # In order of closing, so that a range of it skips row groups.
        laid = newest.withColumn("shared", shared).hint("rebalance", "bucket").sortWithinPartitions("bucket", "closed_at", "url")
        commits.write_part(laid, store.home, LATEST_TABLE, part, "bucket")
    return commits.commit_merge(spark, store.home, seen, part, [*seen.gone, *seen.batches])


@dataclass(frozen=True)
class Current:
    """Latest versions as of one moment. ``settled`` rows need no comparing any more, ``open`` ones do."""

    settled: DataFrame
    open: DataFrame
    both: DataFrame

    def versions(self) -> DataFrame:
        """For any metric in place of ``pulls``: nothing it would use is missing, superseded versions are.

        As read, without the joins that tell settled rows from open ones.
        """
        return self.both

    def latest(self, repos: Repos | None = None, excluded: Repos | None = None) -> DataFrame:
        """The same as ``metrics.latest_pulls`` over all versions.

        A filter on it reaches the scan of the kept rows: only those with a newer version
        since the last merge, or known in several repositories, are compared.
        """
        chosen = latest_per_key(select_repos(self.open, repos, excluded), ["url"], VERSION)
        return select_repos(self.settled, repos, excluded).unionByName(chosen)


def read_current(spark: SparkSession, store: Store, seen: commits.Parts | None = None) -> Current:
    """Latest versions: those kept by the last merges, with what came in since; or as of an earlier look at the parts."""
    seen = commits.parts(spark, store.home) if seen is None else seen
    base = _base(spark, store, seen)
    fresh = read_committed(spark, store, PULLS_TABLE, seen.batches)
    touched = fresh.select("url").distinct()
    alone = base.where(~F.col("shared"))
    settled = alone.join(touched, "url", "left_anti").drop("shared")
    compared = base.where("shared").unionByName(alone.join(touched, "url", "left_semi")).drop("shared")
    return Current(
        settled.select(*fresh.columns),
        compared.select(*fresh.columns).unionByName(fresh),
        base.select(*fresh.columns).unionByName(fresh),
    )


def remove_merged(spark: SparkSession, store: Store) -> int:
    """Deletes what merges have replaced; see ``commits.remove_replaced``. Buckets nobody reads any more stay."""
    return commits.remove_replaced(spark, store.home, list(LAYOUT))
