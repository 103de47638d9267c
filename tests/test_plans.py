"""Plans that must hold at any size."""

from mergetide.functions.dates import DAY_US
from mergetide.operators.asof import asof_join
from mergetide.operators.repos import keep_repos
from mergetide.operators.rolling import rolling_range_avg
from mergetide.plans import metrics
from mergetide.session import shared_dir
from mergetide.sources.admission import admit
from mergetide.sources.ingest import raw_rows
from mergetide.sources.landing import named_pages, read_landed
from tests.helpers import plan, pull_table, ts


def parquet(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_metrics_read_only_what_they_need(spark, tmp_path):
    pulls = pull_table(spark, ("u", "r", "2024-01-01", None, "2024-01-02", "2024-01-02"))
    pulls = parquet(spark, pulls.selectExpr("*", "'x' as etag", "true as draft", "'closed' as state"), tmp_path / "p")
    text = plan(metrics.closed_count(pulls, "2024-01-01", "2024-01-10", repos=["r"]))
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "url", "repo", "closed_at", "updated_at", "raw_id", "item_pos",
    }
    assert "PushedFilters: [EqualTo(repo,r)]" in text or "EqualTo(repo,r)" in text
    assert "WindowGroupLimit" in text

    text = plan(metrics.merged_duration_rolling(pulls, "2024-01-01", "2024-01-10"))
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text


def test_only_small_lists_are_broadcast(spark, tmp_path):
    """Spark decides by size; nothing is hinted."""
    pulls = parquet(spark, pull_table(spark, ("u", "r", "2024-01-01", None, None, "2024-01-02")), tmp_path / "p")
    listed = parquet(spark, spark.range(1000).selectExpr("'r' || id as repo"), tmp_path / "r")
    query = keep_repos(pulls, listed)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "Broadcast" not in plan(keep_repos(pulls, listed))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "LeftSemi" in plan(query)


def test_page_text_is_not_shuffled(spark, tmp_path):
    body = "run_id string, owner string, repo string, page_no int, etag string, fetched_at string, body string"
    spark.createDataFrame([("r", "o", "n", 1, "e", "2024-01-01T00:00:00Z", "[]")], body).write.json(str(tmp_path / "in"))
    cutoffs = spark.createDataFrame([("r", "o", "n", 2)], "run_id string, owner string, repo string, first_stale int")
    cutoffs = parquet(spark, cutoffs, tmp_path / "cutoffs")
    admitted = raw_rows(admit(named_pages(read_landed(spark, str(tmp_path / "in"))), cutoffs), 0)
    assert "BroadcastHashJoin" in plan(admitted) and "Exchange hashpartitioning" not in plan(admitted)
    assert admitted.count() == 1


def test_scratch_is_where_the_cluster_says(spark, tmp_path):
    class Cluster:  # the setting is fixed once a session runs
        conf = {"spark.checkpoint.dir": f"{tmp_path}/"}

    first, second = shared_dir(Cluster), shared_dir(Cluster)
    assert first != second and first.startswith(f"{tmp_path}/mergetide-")
    assert not shared_dir(spark).startswith(str(tmp_path))


def test_hot_keys_are_cut(spark):
    """Every window of the bucketed operators groups by more than the key."""
    df = spark.createDataFrame([(1, "k", ts("2024-01-01"), 1.0)], "id long, k string, t timestamp_ntz, v double")
    text = plan(rolling_range_avg(df, ["k"], "t", "v", 30 * DAY_US, "m"))
    windows = [line for line in text.splitlines() if "- Window [" in line]
    assert windows and all("_bucket" in line for line in windows)
    joined = asof_join(df, df.selectExpr("k", "t as u", "v as w"), ["k"], "t", "u", ["w"], method="bucketed")
    windows = [line for line in plan(joined).splitlines() if "- Window [" in line]
    # Within an hour, and one over the hours of a key.
    assert len(windows) == 2 and sum("_stretch" in line.split("windowspecdefinition(")[1] for line in windows) == 1
    joined = asof_join(df, df.selectExpr("k", "t as u", "v as w"), ["k"], "t", "u", ["w"], method="bucketed", buckets=(1_000_000, 86_400))
    windows = [line for line in plan(joined).splitlines() if "- Window [" in line]
    # Within a second, within a day of seconds, and one over the days of a key.
    assert len(windows) == 3 and sum("_stretch" in line.split("windowspecdefinition(")[1] for line in windows) == 2


def test_only_hot_keys_are_cut_by_measure(spark):
    """A window and one shuffle where no key is hot; where some are, these alone go by stretches."""
    events = [(i, "hot" if i % 2 else f"k{i % 20}", ts("2024-01-01")) for i in range(60)]
    df = spark.createDataFrame(events, "id long, k string, t timestamp_ntz")
    right = df.selectExpr("k", "t as u", "id as w")
    text = plan(asof_join(df, right, ["k"], "t", "u", ["w"]))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("- Window [") == 1
    text = plan(asof_join(df, right, ["k"], "t", "u", ["w"], hot_rows=50))
    assert "LeftAnti" in text and "LeftSemi" in text and "_stretch" in text
