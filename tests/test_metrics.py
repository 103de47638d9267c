from datetime import date

import pytest

from mergetide.plans import metrics
from mergetide.plans.views import register_views
from tests.helpers import pr, pull_table, raw_table, rows

D = date


def durations(df):
    return {(r["day"].isoformat(), r["repo"]): r["duration"] for r in df.collect()}


@pytest.fixture(scope="module")
def pulls(spark):
    return pull_table(
        spark,
        # url, repo, created, merged, closed, updated
        ("a1", "a", "2024-01-01", None, None, "2024-01-01"),
        ("a1", "a", "2024-01-01", "2024-01-03", "2024-01-03", "2024-01-03"),
        # Created after a1 but merged the same day: the day stands for this one, whose frame holds both.
        ("a2", "a", "2024-01-02", "2024-01-03 12:00:00", "2024-01-03 12:00:00", "2024-01-03 12:00:00"),
        # Merged once, but its newest version is not: out.
        ("a3", "a", "2024-01-02", "2024-01-04", "2024-01-04", "2024-01-04"),
        ("a3", "a", "2024-01-02", None, None, "2024-01-05"),
        # Within 30 days of creation and merged later: counts in a2's frame only if created before it.
        ("a4", "a", "2024-01-01 12:00:00", "2024-01-07 12:00:00", "2024-01-07 12:00:00", "2024-01-07 12:00:00"),
        # Closed without a merge.
        ("b1", "b", "2024-01-05", None, "2024-01-06", "2024-01-06"),
        ("b2", "b", "2023-11-01", "2023-12-01", "2023-12-01", "2023-12-01"),
        ("n1", None, "2024-01-01", "2024-01-02", "2024-01-02", "2024-01-02"),
    )


@pytest.mark.parametrize("staged", [False, True])
def test_rolling_duration(pulls, tmp_path, staged):
    stage = str(tmp_path / "merged") if staged else None
    found = metrics.merged_duration_rolling(pulls, "2024-01-02", "2024-01-08", stage=stage)
    # The newest of a's frame on 01-03 is a2: a1 (2 d), a4 (6 d), a2 (1.5 d) were created up to then.
    a = (2 + 6 + 1.5) / 3
    # On 01-07 it is a4, whose frame ends before a2 was created.
    a4 = (2 + 6) / 2
    expected = {("2024-01-02", None): None}
    expected |= {(f"2024-01-0{d}", "a"): a for d in range(3, 7)}
    expected |= {(f"2024-01-0{d}", "a"): a4 for d in (7, 8)}
    expected |= {(f"2024-01-0{d}", "b"): 30.0 for d in range(2, 9)}
    assert durations(found) == pytest.approx(expected)
    order = [(r["day"], r["repo"]) for r in found.collect()]
    assert order == sorted(order, key=lambda r: (r[0], r[1] is None, r[1]))
    assert [f.dataType.simpleString() for f in found.schema] == ["date", "string", "double"]


def test_rolling_duration_selection(pulls):
    def run(**options):
        return durations(metrics.merged_duration_rolling(pulls, "2024-01-02", "2024-01-03", **options))

    assert ("2024-01-02", None) not in run(drop_unmatched=True)
    assert set(run(repos=["b", "b"])) == {("2024-01-02", "b"), ("2024-01-03", "b")}
    assert set(run(repos=["a", "zz"])) == {("2024-01-02", None), ("2024-01-03", "a"), ("2024-01-03", None)}
    assert set(run(excluded=["a"])) == {("2024-01-02", "b"), ("2024-01-03", "b")}
    assert run(excluded=["a", "b"]) == {}
    assert set(run(repos=["a", "b"], excluded=["a"])) == {("2024-01-02", "b"), ("2024-01-03", "b")}
    assert durations(metrics.merged_duration_rolling(pulls, "2024-01-03", "2024-01-02")) == {}


def test_calendar_and_elapsed_ages(spark):
    """A leap day: the calendar counts a month and two days, the clock 31 days."""
    pulls = pull_table(spark, ("u", "r", "2024-02-29", "2024-03-31", "2024-03-31", "2024-03-31"))
    for age, days in [("calendar", 32.0), ("elapsed", 31.0)]:
        found = metrics.merged_duration_rolling(pulls, "2024-03-31", "2024-03-31", age=age)
        assert durations(found) == {("2024-03-31", "r"): days}


def test_merge_without_creation_time(spark):
    pulls = pull_table(spark, ("u", "r", None, "2024-01-02", "2024-01-02", "2024-01-02"))
    found = metrics.merged_duration_rolling(pulls, "2024-01-01", "2024-01-02")
    assert durations(found) == {("2024-01-01", None): None, ("2024-01-02", "r"): None}


def test_closed_range_is_on_the_timestamp(spark):
    pulls = pull_table(
        spark,
        ("in", "r", "2024-01-01", None, "2024-01-31 00:00:00", "2024-01-31"),
        ("out", "r", "2024-01-01", None, "2024-01-31 05:00:00", "2024-01-31"),
        ("first", "r", "2024-01-01", "2024-01-10", "2024-01-10", "2024-01-10"),
        ("early", "r", "2024-01-01", None, "2024-01-09 23:59:59", "2024-01-10"),
    )
    found = metrics.closed_items(pulls, "2024-01-10", "2024-01-31")
    assert {r["url"]: r["closed_at"] for r in found.collect()} == {"in": D(2024, 1, 31), "first": D(2024, 1, 10)}
    assert found.columns == ["url", "repo", "created_at", "merged_at", "updated_at", "closed_at"]


def test_closed_counts(spark):
    closed = ["2024-01-06 10:00:00", "2024-01-06 11:00:00", "2024-01-07", "2024-01-13"]
    versions = [(f"u{i}", "r", "2024-01-01", None, c, c) for i, c in enumerate(closed)]
    pulls = pull_table(spark, *versions)
    daily = metrics.closed_count(pulls, "2024-01-01", "2024-03-11")  # 70 days
    assert rows(daily) == [(D(2024, 1, 6), "r", 2), (D(2024, 1, 7), "r", 1), (D(2024, 1, 13), "r", 1)]
    weekly = metrics.closed_count(pulls, "2024-01-01", "2024-03-12")  # 71 days
    assert rows(weekly) == [(D(2023, 12, 31), "r", 2), (D(2024, 1, 7), "r", 2)]


def test_freshness(spark, pulls):
    assert metrics.source_freshness(pulls).first()["updated_at_text"] == "2024-01-07T12:00:00Z"
    assert metrics.source_freshness(pulls.limit(0)).first()["updated_at_text"] == "1970-01-01T00:00:00Z"
    assert metrics.raw_freshness(raw_table(spark, [])).first()["updated_at_text"] == "1970-01-01T00:00:00Z"


@pytest.mark.parametrize("cache", [False, True])
def test_overview_matches_its_parts(pulls, cache):
    both = metrics.overview(pulls, "2024-01-01", "2024-01-10", cache=cache)
    assert durations(both.durations) == durations(metrics.merged_duration_rolling(pulls, "2024-01-01", "2024-01-10"))
    assert rows(both.counts) == rows(metrics.closed_count(pulls, "2024-01-01", "2024-01-10"))
    both.release()


def test_delivered_twice_changes_nothing(spark, pulls):
    twice = pulls.unionByName(pulls)
    for metric in (metrics.merged_duration_rolling, metrics.closed_items, metrics.closed_count):
        assert rows(metric(twice, "2024-01-01", "2024-01-10")) == rows(metric(pulls, "2024-01-01", "2024-01-10"))


def test_views(spark):
    raw = raw_table(
        spark,
        [pr(1, "2024-01-01T00:00:00Z"), pr(2, "2024-01-01T00:00:00Z")],
        [pr(1, "2024-01-01T00:00:00Z", closed="2024-01-02T00:00:00Z")],
    )
    register_views(spark, raw, prefix="my_")
    assert spark.sql("select count(*) from my_pulls").first()[0] == 3
    assert spark.sql("select count(*) from my_pulls_latest where state = :s", args={"s": "closed"}).first()[0] == 1
    assert spark.table("my_raw_payload").count() == 2


def test_other_time_zones_are_refused(spark, pulls):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        with pytest.raises(ValueError):
            metrics.merged_duration_rolling(pulls, "2024-01-01", "2024-01-02")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
