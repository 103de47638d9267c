"""The rolling time-to-merge kept up to date batch by batch.

For every repository and merge day the state holds the moment its value stands for, and
exact sums: the total age and number of the merges in the 30 days up to it. New batches
change few merges. What they add to or take from a frame is added to its kept sums; only
days on which a merge appeared, moved or vanished are computed anew, from the merges of
their own frames. Updates are committed like batches, one after another: of two at once
the slower one leaves no trace.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergetide.functions.dates import DAY_US, calendar_age_us
from mergetide.operators.latest import latest_per_key
from mergetide.operators.rolling import rolling_sums_at
from mergetide.plans.metrics import ROLLING_DAYS, SECOND_US, Moment, on_calendar, points_seen
from mergetide.session import require_utc
from mergetide.sources import commits
from mergetide.sources.compaction import VERSION, read_current
from mergetide.sources.tables import PULLS_TABLE, Store, read_committed

POINTS = "repo string, merged_date date, created_at timestamp_ntz, total decimal(38,0), n bigint, gone boolean, step bigint"
COVERED = "batch_id bigint"
DAY = ["repo", "merged_date"]
FOLD_AFTER = 32  # updates, then all of them become one
WIDTH = ROLLING_DAYS * DAY_US


def _home(store: Store) -> str:
    return store.path("rolling")


def _points(spark: SparkSession, store: Store, seen: commits.Parts) -> DataFrame:
    return latest_per_key(commits.read_parts(spark, _home(store), "points", POINTS, seen.live), DAY, ["step"])


def read_points(spark: SparkSession, store: Store) -> DataFrame:
    """``(repo, merged_date, created_at, total, n)`` as of the last update."""
    return _points(spark, store, commits.parts(spark, _home(store))).where("not gone").drop("gone", "step")


def _merges(latest: DataFrame) -> DataFrame:
    return latest.where(F.col("merged_at").isNotNull()).select(
        "repo",
        F.col("merged_at").cast("date").alias("merged_date"),
        "created_at",
        calendar_age_us("merged_at", "created_at").cast("decimal(20,0)").alias("age_us"),
    )


def _near(rows: DataFrame, frames: DataFrame, before: int, after: int) -> DataFrame:
    """Rows of the repositories of ``frames``, no further in time from all of them than asked, in microseconds."""

    def moved(bound: str, by: int):
        return F.col(bound) + F.make_dt_interval(secs=F.lit(by / SECOND_US).cast("decimal(18,6)"))

    bounds = frames.groupBy(F.col("repo").alias("_repo")).agg(F.min("created_at").alias("_lo"), F.max("created_at").alias("_hi"))
    near = F.col("created_at").between(moved("_lo", -before), moved("_hi", after))
    return rows.join(bounds, F.col("repo").eqNullSafe(F.col("_repo")) & near, "left_semi")


def update_points(spark: SparkSession, store: Store) -> bool:
    """Takes in the batches committed since the last update. False if there were none, or another update came first."""
    require_utc(spark)
    home = _home(store)
    seen, stored = commits.parts(spark, home), commits.parts(spark, store.home)
    covered = commits.read_parts(spark, home, "covered", COVERED, seen.live)
    pulls = read_committed(spark, store, PULLS_TABLE, stored.live)
    part = f"c{uuid.uuid4().hex}"

    def staged(df: DataFrame, name: str) -> DataFrame:
        path = f"{home}/staged/{part}/{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    batches = staged(pulls.select("batch_id").distinct().join(covered, "batch_id", "left_anti"), "batches")
    if batches.isEmpty():
        return False

    # What the new versions change: merges of before taken away, those of now added, equal ones cancelled out.
    fresh = pulls.join(batches, "batch_id", "left_semi")
    touched = pulls.join(fresh.select("url").distinct(), "url", "left_semi").join(
        batches.withColumn("fresh", F.lit(True)), "batch_id", "left"
    )
    columns = ["url", "repo", "created_at", "merged_at", *VERSION]
    versions = staged(touched.select(*columns, F.coalesce("fresh", F.lit(False)).alias("fresh")), "versions")
    now = _merges(latest_per_key(versions, ["url"], VERSION)).withColumn("weight", F.lit(1))
    then = _merges(latest_per_key(versions.where("not fresh"), ["url"], VERSION)).withColumn("weight", F.lit(-1))
    net = now.unionByName(then).groupBy(*DAY, "created_at", "age_us").agg(F.sum("weight").alias("weight"))
    changed = staged(net.where("weight <> 0"), "changed")
    days = changed.select(*DAY).distinct()

    points = _points(spark, store, seen)
    kept = points.where("not gone").join(days, DAY, "left_anti").select(*DAY, "created_at", "total", "n")
    reached = staged(_near(kept, changed, 0, WIDTH), "reached")
    moved = rolling_sums_at(
        changed, reached.select("repo", "created_at"), ["repo"], "created_at", "age_us", WIDTH, grain=SECOND_US, weight="weight"
    ).withColumnsRenamed({"total": "_total", "n": "_n"})
    added = reached.join(moved.where("_n <> 0 or _total <> 0"), ["repo", "created_at"]).select(
        *DAY, "created_at", (F.coalesce("total", F.lit(0)) + F.coalesce("_total", F.lit(0))).alias("total"), (F.col("n") + F.col("_n")).alias("n")
    )

    # Needed twice: the latest versions are told from the others once.
    merges = staged(_merges(read_current(spark, store, stored).latest()), "merges")
    picks = merges.join(days, DAY, "left_semi").groupBy(*DAY).agg(F.max("created_at").alias("created_at"))
    picks = staged(picks, "picks")
    anew = rolling_sums_at(
        _near(merges, picks, WIDTH, 0), picks.select("repo", "created_at"), ["repo"], "created_at", "age_us", WIDTH, grain=SECOND_US
    ).withColumnsRenamed({"repo": "_repo", "created_at": "_at"})
    same = F.col("repo").eqNullSafe(F.col("_repo")) & F.col("created_at").eqNullSafe(F.col("_at"))
    computed = picks.join(anew, same, "left").select(*DAY, "created_at", "total", F.coalesce("n", F.lit(0)).alias("n"))
    none = days.join(picks, DAY, "left_anti").select(
        *DAY, F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("decimal(38,0)").alias("total"), F.lit(0).cast("long").alias("n")
    )

    step = F.lit(len(seen.records)).cast("long")
    changes = added.unionByName(computed).withColumn("gone", F.lit(False)).unionByName(none.withColumn("gone", F.lit(True)))
    rows = changes.withColumn("total", F.col("total").cast("decimal(38,0)")).withColumn("step", step)
    replaces: list[str] = []
    if len(seen.live) >= FOLD_AFTER:
        rows = latest_per_key(points.unionByName(staged(rows, "rows")), DAY, ["step"])
        batches, replaces = covered.unionByName(batches), [*seen.gone, *seen.live]
    commits.write_part(rows.select(*points.columns), home, "points", part)
    commits.write_part(batches.coalesce(1), home, "covered", part)
    return commits.commit_merge(spark, home, seen, part, replaces)


def merged_duration_kept(
    points: DataFrame, calendar_repos: DataFrame, start: Moment, end: Moment, drop_unmatched: bool = False
) -> DataFrame:
    """``metrics.merged_duration_rolling`` from the kept state: a row per repository and merge day is read, no history.

    ``calendar_repos`` are the repositories that get a calendar, in ``repo``.
    """
    seen = points_seen(points, ["created_at", "total", "n"], start, end)
    mean = F.when(F.col("n") > 0, F.col("total").cast("double") / F.col("n"))
    rolling = seen.select(F.col("repo").alias("merged_repo"), "repo", "seen_from", (mean / DAY_US).alias("duration"))
    return on_calendar(rolling, calendar_repos, start, end, drop_unmatched).orderBy(F.asc("day"), F.asc_nulls_last("repo"))
