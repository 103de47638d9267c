"""Delivery metrics over the ``pulls`` table (one row per version of a pull request).

Range bounds are UTC, or carry an offset; ``functions.ranges`` makes them from
presets and defaults. ``repos`` keeps the listed repositories (none = all),
``excluded`` drops the listed ones. Results are unsorted unless said otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergetide.functions.dates import DAY_US, calendar_age_us, day_bin, elapsed_us, iso_utc, timestamp_lit, week_bin
from mergetide.functions.json_shred import repo_id, shred
from mergetide.functions.ranges import bin_unit, to_utc
from mergetide.operators.asof import asof_join
from mergetide.operators.calendar import with_days
from mergetide.operators.latest import latest_per_key
from mergetide.operators.repos import Repos, distinct_repos, repo_frame, select_repos
from mergetide.operators.rolling import rolling_avg_at
from mergetide.schemas import MARK_FIELDS, PULL_FIELDS, REPO_FIELDS
from mergetide.session import require_utc

Moment = datetime | date | str

ROLLING_DAYS = 30
# The API gives times in whole seconds; finer ones would only make tasks larger.
SECOND_US = 1_000_000
EPOCH = "1970-01-01 00:00:00"


def pulls_from_raw(raw: DataFrame, on_error: str = "raise") -> DataFrame:
    """Shred raw pages into one row per pull-request version."""
    keep = [c for c in ("id", "created_at", "owner", "repo", "etag", "batch_id") if c in raw.columns]
    renamed = {"id": "raw_id", "created_at": "raw_created_at", "owner": "page_owner", "repo": "page_repo"}
    pages = raw.select(*keep, "data").withColumnsRenamed(renamed)
    rows = shred(pages, "data", PULL_FIELDS, keep=[renamed.get(c, c) for c in keep], on_error=on_error)
    return rows.withColumn("repo", repo_id("login", "name")).drop("login", "name")


def repos_in_raw(raw: DataFrame) -> DataFrame:
    """Distinct repositories straight from raw pages, reading only the name fields."""
    return distinct_repos(shred(raw, "data", REPO_FIELDS).select(repo_id("login", "name").alias("repo")))


def latest_pulls(pulls: DataFrame, repos: Repos | None = None, excluded: Repos | None = None) -> DataFrame:
    """The newest version of each pull request of the selected repositories.

    Repositories are selected first, as pages of several may carry the same url.
    Equal update times are settled by page, then place on the page.
    """
    return latest_per_key(select_repos(pulls, repos, excluded), ["url"], ["updated_at", "raw_id", "item_pos"])


def _rolling(
    latest: DataFrame,
    calendar_repos: DataFrame,
    start: Moment,
    end: Moment,
    drop_unmatched: bool = False,
    age: str = "calendar",
    stage: str | None = None,
) -> DataFrame:
    if age not in ("calendar", "elapsed"):
        raise ValueError("age is 'calendar' or 'elapsed'")
    # Ages are whole microseconds, so sums are exact in any order.
    age_us = (calendar_age_us if age == "calendar" else elapsed_us)("merged_at", "created_at")
    merged = latest.where(F.col("merged_at").isNotNull()).select(
        "repo",
        "created_at",
        F.col("merged_at").cast("date").alias("merged_date"),
        age_us.cast("decimal(20,0)").alias("age_us"),
    )
    if stage:
        merged.write.mode("overwrite").parquet(stage)
        merged = latest.sparkSession.read.schema(merged.schema).parquet(stage)
    # A merge day stands for its pull request created last; the average depends on nothing else of it.
    picks = points_seen(merged, ["created_at"], start, end)
    rolling = rolling_avg_at(
        merged, picks, ["repo"], "created_at", "age_us", ROLLING_DAYS * DAY_US, "mean_us", grain=SECOND_US
    ).select(F.col("repo").alias("merged_repo"), "repo", "seen_from", (F.col("mean_us") / DAY_US).alias("duration"))

    return on_calendar(rolling, calendar_repos, start, end, drop_unmatched)


def points_seen(days: DataFrame, of: list[str], start: Moment, end: Moment) -> DataFrame:
    """``(repo, seen_from, *of)``: from which day of the range on the values ``of`` a merge day can be looked up.

    Of equal days the greatest ``of`` counts. Days after the range never are looked up, and of
    those before it only the last one is, on the first day.
    """
    first, last = timestamp_lit(start).cast("date"), timestamp_lit(end).cast("date")
    return (
        days.where(F.col("merged_date") <= last)
        .groupBy("repo", F.greatest("merged_date", first).alias("seen_from"))
        .agg(F.max(F.struct("merged_date", *of)).alias("newest"))
        .select("repo", "seen_from", *[f"newest.{c}" for c in of])
    )


def on_calendar(
    rolling: DataFrame, calendar_repos: DataFrame, start: Moment, end: Moment, drop_unmatched: bool = False
) -> DataFrame:
    """``(day, repo, duration)`` for every day of the range and repository: the last value seen up to it."""
    calendar = with_days(calendar_repos, timestamp_lit(start), timestamp_lit(end))
    # Both sides are down to days per repository here, so a key fits a task.
    matched = asof_join(
        calendar,
        rolling,
        by=["repo"],
        left_on="day",
        right_on="seen_from",
        payload=["merged_repo", "duration"],
        how="inner" if drop_unmatched else "left",
        method="window",
        unique_right=True,
    )
    return matched.groupBy("day", F.col("merged_repo").alias("repo")).agg(F.avg("duration").alias("duration"))


def merged_duration_rolling(
    pulls: DataFrame,
    start: Moment,
    end: Moment,
    repos: Repos | None = None,
    excluded: Repos | None = None,
    drop_unmatched: bool = False,
    age: str = "calendar",
    stage: str | None = None,
    latest: DataFrame | None = None,
) -> DataFrame:
    """``(day, repo, duration)``: days to merge, 30-day rolling average, for every day and repository.

    The value of a day is that of the last merge day up to it: the mean age at
    merge over pull requests created in the 30 days up to the creation of that
    day's pull request. All history counts; the range only bounds the calendar.
    Days before a repository's first merge share one row with NULL repo and
    duration, unless ``drop_unmatched``. Sorted by day and repository.

    The merged pull requests are needed twice. Both uses share the shuffle that
    finds them, but each sorts what it receives; on a long history name a folder
    to ``stage`` them in instead: four narrow columns per merge.

    ``latest`` are the selected repositories' newest versions where something keeps them
    (``sources.compaction.read_current``); then ``pulls`` only says which repositories there are.
    """
    require_utc(pulls.sparkSession)
    latest = latest_pulls(pulls, repos, excluded) if latest is None else latest
    if repos is None or (not isinstance(repos, DataFrame) and not repos):
        days_for = distinct_repos(select_repos(pulls, None, excluded))
    else:
        days_for = repo_frame(pulls, repos)
        days_for = days_for if excluded is None else select_repos(days_for, None, excluded)
    result = _rolling(latest, days_for, start, end, drop_unmatched, age, stage)
    return result.orderBy(F.asc("day"), F.asc_nulls_last("repo"))


def closed_among(latest: DataFrame, start: Moment, end: Moment) -> DataFrame:
    """Of the newest versions those closed between two instants. On kept ones the range reaches their scan."""
    # On the timestamp: after midnight of the end date is out of range.
    in_range = F.col("closed_at").between(timestamp_lit(start), timestamp_lit(end))
    return latest.where(in_range).select(
        "url", "repo", "created_at", "merged_at", "updated_at", F.col("closed_at").cast("date").alias("closed_at")
    )


def closed_items(
    pulls: DataFrame, start: Moment, end: Moment, repos: Repos | None = None, excluded: Repos | None = None
) -> DataFrame:
    """Pull requests closed, merged or not, between two instants (inclusive)."""
    return closed_among(latest_pulls(pulls, repos, excluded), start, end)


def _count(closed: DataFrame, unit: str) -> DataFrame:
    if unit not in ("day", "week"):
        raise ValueError("unit is 'day' or 'week'")
    binned = week_bin("closed_at") if unit == "week" else day_bin("closed_at")
    return closed.groupBy(binned.alias("bin"), "repo").agg(F.count(F.lit(1)).alias("count"))


def _unit(start: Moment, end: Moment, unit: str | None) -> str:
    if unit:
        return unit
    first, last = (to_utc(m if isinstance(m, datetime) else str(m)) for m in (start, end))
    return bin_unit(first, last)


def closed_count(
    pulls: DataFrame,
    start: Moment,
    end: Moment,
    repos: Repos | None = None,
    excluded: Repos | None = None,
    unit: str | None = None,
) -> DataFrame:
    """``(bin, repo, count)`` of closed pull requests by day, or by Sunday week for spans over 70 days."""
    return count_closed(closed_items(pulls, start, end, repos, excluded), start, end, unit)


def count_closed(closed: DataFrame, start: Moment, end: Moment, unit: str | None = None) -> DataFrame:
    """``closed_count`` of the closed items of a range."""
    return _count(closed, _unit(start, end, unit))


def source_freshness(marks: DataFrame) -> DataFrame:
    """One row: the latest item update (epoch if there is no data), as timestamp and text.

    From the marks of a store, a row for each repository and batch, which know it already;
    or from ``pulls``, where nothing keeps marks.
    """
    latest = F.coalesce(F.max("updated_at"), timestamp_lit(EPOCH))
    return marks.agg(latest.alias("updated_at")).withColumn("updated_at_text", iso_utc("updated_at"))


def raw_freshness(raw: DataFrame) -> DataFrame:
    """``source_freshness`` straight from raw pages, reading only the update times."""
    return source_freshness(shred(raw, "data", MARK_FIELDS))


@dataclass
class Overview:
    """Both charts of a range. ``release()`` frees what they share."""

    durations: DataFrame
    counts: DataFrame
    latest: DataFrame

    def release(self) -> None:
        self.latest.unpersist()


def overview(
    pulls: DataFrame, start: Moment, end: Moment, unit: str | None = None, cache: bool = False
) -> Overview:
    """Rolling durations and closed counts over all repositories, deduplicated once for both.

    Written out as one query the two share the shuffle that deduplicates. To run
    them one after the other, ``cache`` keeps the shared rows on the executors; a
    lost executor's are computed again from the source.
    """
    require_utc(pulls.sparkSession)
    latest = latest_pulls(pulls).select("url", "repo", "created_at", "merged_at", "updated_at", "closed_at")
    if cache:
        latest = latest.persist(StorageLevel.MEMORY_AND_DISK)
    durations = _rolling(latest, distinct_repos(pulls), start, end)
    counts = _count(closed_among(latest, start, end), _unit(start, end, unit))
    return Overview(durations.orderBy(F.asc("day"), F.asc_nulls_last("repo")), counts, latest)
