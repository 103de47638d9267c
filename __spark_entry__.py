"""

Pull-request queries run the whole way from the ``orders`` table: orders become
JSON pages, pages are shredded strictly, and the operators work on the rows.
Dates leave as ISO text, because DuckDB and Spark hand DATE to pandas differently.
Averages are taken over exact sums (whole microseconds, decimals) on both sides, so
that neither summation order nor rounding of halves can tell the results apart.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergetide.functions.dates import (
    DAY_US,
    calendar_age_days,
    calendar_age_us,
    day_bin,
    elapsed_days,
    timestamp_lit,
    week_bin,
)
from mergetide.functions.json_shred import json_text, repo_id, shred
from mergetide.functions.ranges import PRESET_DAYS, preset_range, resolve_range
from mergetide.operators.asof import asof_join
from mergetide.operators.calendar import with_days
from mergetide.operators.latest import latest_per_key
from mergetide.operators.repos import distinct_repos, drop_repos, keep_repos
from mergetide.operators.rolling import rolling_range_avg
from mergetide.operators.search import bm25, search
from mergetide.plans import metrics
from mergetide.plans.rolling_state import merged_duration_kept, read_points, update_points
from mergetide.plans.views import register_views
from mergetide.schemas import PULL_FIELDS
from mergetide.session import configure, shared_dir
from mergetide.sources.admission import admit, page_news, run_cutoffs
from mergetide.sources.compaction import merge_batches, read_current
from mergetide.sources.ingest import append_pages, claim_batch, ingest_once, raw_rows, retry_failed, set_aside
from mergetide.sources.landing import land_files, parse_repos, read_landed
from mergetide.sources.marks import high_water_marks, marks_or_default
from mergetide.sources.order_pages import order_pages
from mergetide.sources.search_index import SearchIndex, add_documents, score_documents, search_index
from mergetide.sources.search_index import merge_batches as merge_index
from mergetide.sources.sinks import export, small_arrow
from mergetide.sources.tables import Store, read_marks, read_pulls, read_raw
from mergetide.streaming.ingest import start_ingest
from mergetide.streaming.progress import ADMITTED, start_progress

START, END = "1997-01-01 00:00:00", "1997-12-31 00:00:00"
SHORT_START, SHORT_END = "1997-03-01 00:00:00", "1997-05-01 00:00:00"
SOME_REPOS = ["org0/repo0", "org1/repo3", "org2/repo6"]
STORED_BEFORE = "1999-01-01 00:00:00"
# Three runs: each from its start on, and behind that a tail of pages from before it.
RUNS = (
    ("1990-01-01", "1990-01-01", "2000-01-01"),
    ("2000-01-01", "1999-06-01", "2001-01-01"),
    ("2001-01-01", "1999-09-01", "2100-01-01"),
)
TAIL = 10_000_000
CLOCK = datetime(2001, 6, 15, 13, 45)
EARLY_CLOCK = datetime(1997, 6, 15, 13, 45)
OFFSET_START, OFFSET_END = "1997-03-01T05:30:00+02:00", "1997-04-30T20:45:00-03:30"
# Documents are added to the search index in these batches.
INDEX_BATCHES = ("lang = 'en'", "lang = 'de'", "lang is null or lang not in ('en', 'de')")
SEARCH = "der rest of that house"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_pages(_table(spark, sf_dir, "orders"))


def _land(pages: DataFrame, path: str) -> None:
    """Adds pages to a landing folder, compressed at the fastest level: the text is a tenth of its size then, in files of one task each."""
    pages.write.mode("append").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").json(path)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_rows(_pages(spark, sf_dir), batch_id=0)


def _pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pulls_from_raw(_raw(spark, sf_dir))


def _text(date: str, name: str | None = None) -> Column:
    return F.col(date).cast("string").alias(name or date)


def _durations(df: DataFrame) -> DataFrame:
    return df.select(_text("day"), "repo", "duration")


def _counts(df: DataFrame) -> DataFrame:
    return df.select(_text("bin"), "repo", "count")


# --- JSON -------------------------------------------------------------------


def json_strict_shred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pulls(spark, sf_dir).select(
        "url", "repo", "state", "created_at", "closed_at", "merged_at", "updated_at", "draft"
    )


def json_shred_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, every tenth cut short, every tenth with a key renamed: items or what is wrong with them."""
    kind, body = F.col("page_no") % 10, F.col("body")
    cut = F.when(kind == 3, body.substr(F.lit(1), F.length(body) - 1))
    spoilt = cut.when(kind == 5, F.replace(body, F.lit('"draft"'), F.lit('"drafted"'))).otherwise(body)
    pages = _pages(spark, sf_dir).withColumn("body", spoilt)
    found = shred(pages, "body", PULL_FIELDS, keep=["owner", "repo", "page_no"], on_error="report")
    return found.select("owner", "repo", "page_no", "item_pos", "url", "state", "updated_at", "error")


def json_path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", json_text("props", "$.k").alias("k"))


def json_build_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).withColumn("etag", F.when(F.col("page_no") % 10 != 0, F.col("etag")))
    return raw_rows(pages, 0).select("owner", "repo", "page_no", "metadata")


def metadata_path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    owner_and_repo = (json_text("metadata", "$.owner") == "org1") & (json_text("metadata", "$.repo") == "repo3")
    return raw.where(owner_and_repo).select("page_no", json_text("metadata", "$.etag").alias("etag"))


def repo_id_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return _table(spark, sf_dir, "customer").select("c_custkey", repo_id(owner, "c_name").alias("repo"))


# --- filters, joins, latest version ------------------------------------------


def raw_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append pages to a store, read them back by source and type."""
    pages = _pages(spark, sf_dir)
    store = Store(shared_dir(spark))
    append_pages(pages, store, batch_id=0)
    return read_raw(spark, store).select("owner", "repo", "page_no", "etag", "data_source", "data_type")


def latest_pull_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest_pulls(_pulls(spark, sf_dir)).select("url", "repo", "state", "updated_at")


def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return latest_per_key(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "ts")


def repos_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.repos_in_raw(_raw(spark, sf_dir))


def semi_join_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_repos(_pulls(spark, sf_dir), SOME_REPOS).select("repo", "url", "updated_at")


def semi_join_repo_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of repositories as data: those with more customers in one market segment than in another."""
    owner = F.concat(F.lit("org"), (F.col("c_custkey") % 3).cast("string"))
    name = F.concat(F.lit("repo"), (F.col("c_custkey") % 7).cast("string"))
    customers = _table(spark, sf_dir, "customer").select(repo_id(owner, name).alias("repo"), "c_mktsegment")
    listed = customers.groupBy("repo").agg(
        F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"),
        F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("machinery"),
    )
    listed = listed.where("building > machinery")
    return keep_repos(_pulls(spark, sf_dir), listed).select("repo", "url", "updated_at")


def anti_join_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repos(_pulls(spark, sf_dir), SOME_REPOS).select("repo", "url", "updated_at")


# --- calendar ----------------------------------------------------------------


def calendar_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day between a repository's first and last opened pull request."""
    span = _pulls(spark, sf_dir).groupBy("repo").agg(F.min("created_at").alias("lo"), F.max("created_at").alias("hi"))
    return with_days(span, F.col("lo"), F.col("hi")).select("repo", _text("day"))


def calendar_cross_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = distinct_repos(_pulls(spark, sf_dir))
    return with_days(repos, timestamp_lit(START), timestamp_lit(END)).select("repo", _text("day"))


def calendar_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of each shipment at order date; many ship before, so ages are negative too."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey",
        "l_linenumber",
        F.round(calendar_age_days("l_shipdate", "o_orderdate"), 6).alias("age_days"),
        F.round(elapsed_days("l_shipdate", "o_orderdate"), 6).alias("elapsed_days"),
    )


def bin_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return _binned(events, day_bin("ts"))


def bin_week_sunday(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return _binned(events, week_bin("ts"))


def _binned(events: DataFrame, unit: Column) -> DataFrame:
    counts = events.groupBy(unit.alias("bin"), "event_type").agg(F.count(F.lit(1)).alias("count"))
    return counts.select(_text("bin"), "event_type", "count")


def date_range_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders inside each relative range, in one pass over the table."""
    ranges = {name: preset_range(name, CLOCK) for name in [*PRESET_DAYS, "no_such_preset"]}
    orders = _table(spark, sf_dir, "orders")
    counted = orders.agg(
        *[
            F.count_if(F.col("o_orderdate").between(timestamp_lit(start), timestamp_lit(end))).alias(name)
            for name, (start, end) in ranges.items()
        ]
    )
    rows = [
        F.struct(
            F.lit(name).alias("preset"),
            F.lit(start.date().isoformat()).alias("start_day"),
            F.lit(end.date().isoformat()).alias("end_day"),
            F.col(name).alias("orders"),
        )
        for name, (start, end) in ranges.items()
    ]
    return counted.select(F.inline(F.array(*rows)))


# --- windows and as-of joins ---------------------------------------------------


def rolling_avg_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = (
        metrics.latest_pulls(_pulls(spark, sf_dir))
        .where(F.col("merged_at").isNotNull())
        .select(
            "url",
            "repo",
            "created_at",
            calendar_age_us("merged_at", "created_at").cast("decimal(20,0)").alias("age_us"),
        )
    )
    rolled = rolling_range_avg(merged, ["repo"], "created_at", "age_us", 30 * DAY_US, "mean_us", grain=metrics.SECOND_US)
    return rolled.select("url", "repo", "created_at", (F.col("mean_us") / DAY_US).alias("duration"))


def rolling_avg_events_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    rolled = rolling_range_avg(events, ["event_type"], "ts", "value", 3 * DAY_US, "mean_value")
    return rolled.select("event_id", "event_type", "mean_value")


def rolling_avg_events_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    rolled = rolling_range_avg(events, ["user_id"], "ts", "value", 3 * DAY_US, "mean_value", method="plain")
    return rolled.select("event_id", "user_id", "mean_value")


def _clicks_and_purchases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = _table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    purchases = events.where("event_type = 'purchase'").select(
        F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("purchase_ts"), "value"
    )
    return clicks, purchases


def asof_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the user's last purchase so far."""
    clicks, purchases = _clicks_and_purchases(spark, sf_dir)
    return asof_join(
        clicks, purchases, ["user_id"], "ts", "purchase_ts", ["purchase_id", "purchase_ts", "value"], ["purchase_id"]
    )


def asof_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one window per user."""
    clicks, purchases = _clicks_and_purchases(spark, sf_dir)
    return asof_join(
        clicks, purchases, ["user_id"], "ts", "purchase_ts", ["purchase_id", "value"], ["purchase_id"], method="window"
    )


def asof_forward_within_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the user's next purchase, if it comes within a day."""
    clicks, purchases = _clicks_and_purchases(spark, sf_dir)
    return asof_join(
        clicks, purchases, ["user_id"], "ts", "purchase_ts", ["purchase_id", "value"], ["purchase_id"],
        direction="forward", allow_exact=False, tolerance=DAY_US, how="inner",
    )


# --- metrics -------------------------------------------------------------------


def merged_duration_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _durations(metrics.merged_duration_rolling(_pulls(spark, sf_dir), START, END))


def merged_duration_rolling_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list that names one repository twice and one unknown; starts before the first merges."""
    repos = [*SOME_REPOS, SOME_REPOS[0], "org9/unknown"]
    pulls = _pulls(spark, sf_dir)
    return _durations(metrics.merged_duration_rolling(pulls, "1994-12-20 00:00:00", "1995-06-30 00:00:00", repos))


def merged_duration_rolling_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    pulls = _pulls(spark, sf_dir)
    return _durations(metrics.merged_duration_rolling(pulls, SHORT_START, SHORT_END, excluded=SOME_REPOS))


def closed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = metrics.closed_items(_pulls(spark, sf_dir), START, END)
    return items.select("url", "repo", "created_at", "merged_at", "updated_at", _text("closed_at"))


def closed_items_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = metrics.closed_items(_pulls(spark, sf_dir), SHORT_START, SHORT_END, SOME_REPOS)
    return items.select("url", "repo", "created_at", "merged_at", "updated_at", _text("closed_at"))


def closed_count_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(metrics.closed_count(_pulls(spark, sf_dir), SHORT_START, SHORT_END))


def closed_count_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(metrics.closed_count(_pulls(spark, sf_dir), START, END))


def closed_default_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No bounds given: the 30 days up to today's midnight."""
    start, end = resolve_range(EARLY_CLOCK)
    return _counts(metrics.closed_count(_pulls(spark, sf_dir), start, end))


def closed_offset_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds with offsets from UTC, and no whole days."""
    items = metrics.closed_items(_pulls(spark, sf_dir), OFFSET_START, OFFSET_END)
    return items.select("url", "repo", "created_at", "merged_at", "updated_at", _text("closed_at"))


def merged_duration_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric as the driver gets it: an Arrow table in order of day and repository, rows numbered as they come."""
    durations = metrics.merged_duration_rolling(_pulls(spark, sf_dir), SHORT_START, SHORT_END)
    table = small_arrow(durations)
    numbered = table.append_column("position", pa.array(range(table.num_rows), pa.int64()))
    return spark.createDataFrame(numbered).select(_text("day"), "repo", "duration", "position")


def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.raw_freshness(_raw(spark, sf_dir))


def store_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the marks of a store: neither pages nor items are read."""
    root = shared_dir(spark)
    _land(_pages(spark, sf_dir), f"{root}/landing")
    store = Store(f"{root}/store")
    ingest_once(spark, f"{root}/landing", store)
    return metrics.source_freshness(read_marks(spark, store))


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both charts in one table."""
    both = metrics.overview(_pulls(spark, sf_dir), SHORT_START, SHORT_END)
    return _charts(both.durations, both.counts)


def _charts(durations: DataFrame, counts: DataFrame) -> DataFrame:
    durations = durations.select(F.lit("duration").alias("chart"), _text("day"), "repo", F.col("duration").alias("amount"))
    counts = counts.select(
        F.lit("closed").alias("chart"), _text("bin", "day"), "repo", F.col("count").cast("double").alias("amount")
    )
    return durations.unionByName(counts)


def overview_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both charts from kept latest versions: three ingests, the first two merged."""
    root = shared_dir(spark)
    store = Store(f"{root}/store", buckets=8)
    for number, pages in enumerate(_runs(spark, sf_dir)):
        _land(pages, f"{root}/landing-{number}")
        ingest_once(spark, f"{root}/landing-{number}", store)
        if number == 1:
            merge_batches(spark, store)
    current = read_current(spark, store)
    closed = metrics.closed_among(current.latest(), SHORT_START, SHORT_END)
    durations = metrics.merged_duration_rolling(
        current.versions(), SHORT_START, SHORT_END, stage=f"{root}/merges", latest=current.latest()
    )
    return _charts(durations, metrics.count_closed(closed, SHORT_START, SHORT_END))


# --- ingest ----------------------------------------------------------------------


def _stored_pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier ingest holds: two organisations' versions up to a date."""
    earlier = F.col("updated_at") < timestamp_lit(STORED_BEFORE)
    return _pulls(spark, sf_dir).where(earlier & (F.col("page_owner") != "org2"))


def high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return high_water_marks(_pulls(spark, sf_dir)).select("owner", "repo", "etag", "updated_at")


def marks_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = parse_repos(distinct_repos(_pulls(spark, sf_dir)))
    return marks_or_default(asked, high_water_marks(_stored_pulls(spark, sf_dir)))


def page_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a fetch up to the first one without an item at or past the stored mark."""
    pages = _pages(spark, sf_dir)
    items = metrics.pulls_from_raw(pages.withColumnRenamed("body", "data").withColumn("id", F.col("page_no")))
    items = items.select(
        F.lit("run-0").alias("run_id"),
        F.col("page_owner").alias("owner"),
        F.col("page_repo").alias("repo"),
        F.col("raw_id").alias("page_no"),
        "updated_at",
    )
    cutoffs = run_cutoffs(page_news(items), high_water_marks(_stored_pulls(spark, sf_dir)))
    return admit(pages, cutoffs).select("owner", "repo", "page_no", "etag")


def repo_string_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_repos(distinct_repos(_pulls(spark, sf_dir)))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land pages as files, ingest them as a stream, read the latest versions from the store."""
    pages = _pages(spark, sf_dir)
    root = shared_dir(spark)
    _land(pages, f"{root}/landing")
    store = Store(f"{root}/store")
    start_ingest(spark, f"{root}/landing", store, interval=None).awaitTermination()
    return metrics.latest_pulls(read_pulls(spark, store)).select("url", "repo", "state", "updated_at")


def _runs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The pages as three runs fetched one after another; most pages of a tail are stale by then."""
    pages, runs = _pages(spark, sf_dir), []
    for number, (start, tail, end) in enumerate(RUNS):
        old = F.col("fetched_at") < start
        part = pages.where((F.col("fetched_at") >= tail) & (F.col("fetched_at") < end))
        runs.append(
            part.withColumns(
                {"run_id": F.lit(f"run-{number}"), "page_no": F.col("page_no") + F.when(old, TAIL).otherwise(0)}
            )
        )
    return runs


def _admitted(spark: SparkSession, store: Store) -> DataFrame:
    """What a store took: its raw pages, with the items each one gave."""
    items = read_pulls(spark, store).groupBy(F.col("raw_id").alias("id")).agg(F.count("*").alias("items"))
    return read_raw(spark, store).join(items, "id").select("run_id", "owner", "repo", "page_no", "items")


def ingest_once_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three one-shot ingests into one store, each past the marks of those before it."""
    root = shared_dir(spark)
    store = Store(f"{root}/store")
    for number, pages in enumerate(_runs(spark, sf_dir)):
        _land(pages, f"{root}/landing-{number}")
        ingest_once(spark, f"{root}/landing-{number}", store)
    return _admitted(spark, store)


def stream_ingest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same runs landed in one folder, taken by a stream that is started again after each."""
    root = shared_dir(spark)
    store = Store(f"{root}/store")
    for pages in _runs(spark, sf_dir):
        _land(pages, f"{root}/landing")
        start_ingest(spark, f"{root}/landing", store, interval=None).awaitTermination()
    return _admitted(spark, store)


def merged_duration_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling metric from sums that are kept up to date after each of three ingests."""
    root = shared_dir(spark)
    store = Store(f"{root}/store")
    for number, pages in enumerate(_runs(spark, sf_dir)):
        _land(pages, f"{root}/landing-{number}")
        ingest_once(spark, f"{root}/landing-{number}", store)
        update_points(spark, store)
    repos = distinct_repos(read_pulls(spark, store))
    return _durations(merged_duration_kept(read_points(spark, store), repos, START, END))


def stream_ingest_bad_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run with broken pages between two good ones: its repositories with such a page are set aside, the stream goes on."""
    root = shared_dir(spark)
    store = Store(f"{root}/store")
    broken = (F.col("owner") == "org1") & (F.col("page_no") % 5 == 0)
    for number, pages in enumerate(_runs(spark, sf_dir)):
        body = F.when(broken & F.lit(number == 1), F.lit("[{")).otherwise(F.col("body"))
        _land(pages.withColumn("body", body), f"{root}/landing")
        start_ingest(spark, f"{root}/landing", store, interval=None, on_error="isolate").awaitTermination()
    return _admitted(spark, store)


def retried_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of three runs fails as a whole and is tried again after the third: by the marks from before it."""
    root = shared_dir(spark)
    store = Store(f"{root}/store")
    for number, pages in enumerate(_runs(spark, sf_dir)):
        _land(pages, f"{root}/landing-{number}")
        if number == 1:
            failed = read_landed(spark, f"{root}/landing-{number}")
            set_aside(failed, store, claim_batch(spark, store, "fetcher", number), "out of reach")
        else:
            ingest_once(spark, f"{root}/landing-{number}", store)
    retry_failed(spark, store)
    return _admitted(spark, store)


def stream_ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages landed as plain files, taken by a stream; their folders tell everything else, etag included."""
    root = shared_dir(spark)
    land_files(_pages(spark, sf_dir), f"{root}/landing")
    store = Store(f"{root}/store")
    start_ingest(spark, f"{root}/landing", store, interval=None, layout="files").awaitTermination()
    return read_raw(spark, store).select("owner", "repo", "page_no", "etag", "metadata")


def stream_keyed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three runs through a stream that keeps each repository's progress as its state, started again after each."""
    root = shared_dir(spark)
    for pages in _runs(spark, sf_dir):
        _land(pages, f"{root}/landing")
        start_progress(spark, f"{root}/landing", f"{root}/admitted", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(ADMITTED).parquet(f"{root}/admitted")


# --- ad hoc SQL, export, search -----------------------------------------------------


def adhoc_sql_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, _raw(spark, sf_dir))
    return spark.sql(
        """
        select repo, count(*) as items, count_if(state = 'open') as open_items,
               count(distinct cast(created_at as date)) as days
        from pulls_latest where created_at >= :since group by repo
        """,
        args={"since": datetime(1997, 1, 1)},
    )


def _sql(text: str, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {name: _table(spark, sf_dir, name) for name in tables}
        return spark.sql(text.format(**{name: f"{{{name}}}" for name in tables}), **frames)

    return run


# Plain SQL both engines take; table names in braces.
ADHOC = {
    "adhoc_sql_joins": (
        """
        select r.r_name, count(distinct c.c_custkey) as customers, count(o.o_orderkey) as orders
        from {region} r
        join {nation} n on n.n_regionkey = r.r_regionkey
        left join {customer} c on c.c_nationkey = n.n_nationkey
        left join {orders} o on o.o_custkey = c.c_custkey and o.o_orderstatus = 'F'
        group by r.r_name
        """,
        ("region", "nation", "customer", "orders"),
    ),
    "adhoc_sql_anti_join": (
        """
        select c.c_custkey, c.c_name from {customer} c
        where not exists (select 1 from {orders} o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT')
        """,
        ("customer", "orders"),
    ),
    "adhoc_sql_full_join": (
        """
        select coalesce(s.s_nationkey, c.c_nationkey) as nationkey, s.suppliers, c.customers
        from (select s_nationkey, count(*) as suppliers from {supplier} where s_acctbal > 5000 group by s_nationkey) s
        full join (select c_nationkey, count(*) as customers from {customer} where c_acctbal < 0 group by c_nationkey) c
        on s.s_nationkey = c.c_nationkey
        """,
        ("supplier", "customer"),
    ),
    "adhoc_sql_grouping_sets": (
        """
        select l_returnflag, l_linestatus, cast(grouping_id(l_returnflag, l_linestatus) as bigint) as level,
               count(*) as lines, round(sum(l_quantity), 2) as quantity
        from {lineitem} group by cube (l_returnflag, l_linestatus)
        """,
        ("lineitem",),
    ),
    "adhoc_sql_rank_windows": (
        """
        select o_orderkey, o_custkey,
               cast(rank() over (partition by o_custkey order by o_orderdate, o_orderkey) as bigint) as nth,
               lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous,
               cast(ntile(4) over (partition by o_custkey order by o_orderdate, o_orderkey) as bigint) as quarter
        from {orders}
        """,
        ("orders",),
    ),
    "adhoc_sql_set_operations": (
        """
        select c_nationkey as nationkey, 'both' as kind from {customer}
        intersect select s_nationkey, 'both' from {supplier}
        union all
        (select c_nationkey, 'customers only' from {customer} except select s_nationkey, 'customers only' from {supplier})
        """,
        ("customer", "supplier"),
    ),
    "adhoc_sql_text_functions": (
        """
        select p_partkey, upper(p_brand) as brand, regexp_replace(p_name, '^[a-z]+', '*') as masked,
               cast(length(p_type) as integer) as type_length, substring(p_name, 1, 5) as start
        from {part}
        """,
        ("part",),
    ),
    "adhoc_sql_time_bins": (
        """
        select cast(cast(ts as date) as varchar(10)) as day, cast(extract(hour from ts) as bigint) as hour, event_type,
               count(*) as events, round(sum(value), 4) as total
        from {events} group by cast(ts as date), extract(hour from ts), event_type
        """,
        ("events",),
    ),
}


def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts written in each format and read back."""
    counts = metrics.closed_count(_pulls(spark, sf_dir), SHORT_START, SHORT_END)
    schema = counts.schema
    root = shared_dir(spark)
    found = []
    for fmt in ("parquet", "csv", "json"):
        export(counts, f"{root}/{fmt}", fmt)
        reader = spark.read.schema(schema).option("header", True)
        found.append(reader.format(fmt).load(f"{root}/{fmt}").withColumn("format", F.lit(fmt)))
    rows = found[0].unionByName(found[1]).unionByName(found[2])
    return rows.select("format", _text("bin"), "repo", "count")


def export_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed items as the driver gets them: one Arrow table, refused if it were large."""
    closed = metrics.closed_items(_pulls(spark, sf_dir), START, END)
    items = spark.createDataFrame(small_arrow(closed), closed.schema)
    return items.select("url", "repo", "created_at", "merged_at", "updated_at", _text("closed_at"))


def _index(spark: SparkSession, sf_dir: str, merged: bool) -> SearchIndex:
    index, docs = SearchIndex(shared_dir(spark)), _table(spark, sf_dir, "documents")
    for batch in INDEX_BATCHES:
        add_documents(docs.where(batch), index, "doc_id", "text")
    if merged:
        merge_index(spark, index)
    return index


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a stored index of three batches."""
    scored = score_documents(spark, _index(spark, sf_dir, merged=False), SEARCH)
    return scored.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a stored index whose batches were merged."""
    best = search_index(spark, _index(spark, sf_dir, merged=True), SEARCH, k=10)
    return best.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an index, straight from the texts."""
    scored = bm25(_table(spark, sf_dir, "documents"), "doc_id", "text", SEARCH)
    return scored.select("doc_id", F.round("score", 6).alias("score"))


def bm25_scan_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = search(_table(spark, sf_dir, "documents"), "doc_id", "text", SEARCH, k=10)
    return best.select("doc_id", F.round("score", 6).alias("score"))


# --- contract ------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Rolling time-to-merge per repository and day."""
    return merged_duration_rolling(spark, "/root/testdata/sf0.001")


def _llm() -> tuple[dict, dict]:
    """Queries and SQL of the training-data operators; both empty where that subpackage cannot be imported."""
    try:
        import corpus_pipeline
        from mergetide.llm import queries as llm
    except ImportError:
        return {}, {}

    pipeline_sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**llm.QUERIES, "pipeline": corpus_pipeline.run}, {**llm.ORACLE_SQL, **pipeline_sql}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "json_strict_shred": json_strict_shred,
        "json_shred_report": json_shred_report,
        "json_path_extract": json_path_extract,
        "json_build_metadata": json_build_metadata,
        "metadata_path_extract": metadata_path_extract,
        "repo_id_concat": repo_id_concat,
        "raw_scan": raw_scan,
        "latest_per_key": latest_pull_version,
        "latest_event_per_user": latest_event_per_user,
        "distinct_repos": repos_seen,
        "semi_join_repos": semi_join_repos,
        "semi_join_repo_table": semi_join_repo_table,
        "anti_join_excluded": anti_join_excluded,
        "calendar_spine": calendar_spine,
        "calendar_cross_repo": calendar_cross_repo,
        "calendar_age_days": calendar_age,
        "bin_day": bin_day,
        "bin_week_sunday": bin_week_sunday,
        "date_range_presets": date_range_presets,
        "rolling_avg_30d": rolling_avg_30d,
        "rolling_avg_events_3d": rolling_avg_events_3d,
        "rolling_avg_events_plain": rolling_avg_events_plain,
        "asof_left_join": asof_left_join,
        "asof_window_join": asof_window_join,
        "asof_forward_within_day": asof_forward_within_day,
        "merged_duration_rolling": merged_duration_rolling,
        "merged_duration_rolling_repos": merged_duration_rolling_repos,
        "merged_duration_rolling_excluded": merged_duration_rolling_excluded,
        "merged_duration_incremental": merged_duration_incremental,
        "closed_items": closed_items,
        "closed_items_repos": closed_items_repos,
        "closed_count_day": closed_count_day,
        "closed_count_week": closed_count_week,
        "closed_default_range": closed_default_range,
        "closed_offset_range": closed_offset_range,
        "merged_duration_ordered": merged_duration_ordered,
        "source_freshness": source_freshness,
        "store_freshness": store_freshness,
        "overview": overview,
        "overview_kept": overview_kept,
        "high_water_marks": high_water,
        "marks_or_default": marks_with_defaults,
        "page_admission": page_admission,
        "repo_string_parse": repo_string_parse,
        "stream_ingest_equals_batch": stream_ingest,
        "ingest_once_batches": ingest_once_batches,
        "stream_ingest_batches": stream_ingest_batches,
        "stream_ingest_bad_run": stream_ingest_bad_run,
        "stream_ingest_files": stream_ingest_files,
        "stream_keyed_progress": stream_keyed_progress,
        "retried_run": retried_run,
        "adhoc_sql_views": adhoc_sql_views,
        **{name: _sql(text, *tables) for name, (text, tables) in ADHOC.items()},
        "export_roundtrip": export_roundtrip,
        "export_arrow": export_arrow,
        "bm25_scores": bm25_scores,
        "bm25_search": bm25_search,
        "bm25_scan": bm25_scan,
        "bm25_scan_search": bm25_scan_search,
        **_llm()[0],
    }


# The pull requests of sources/order_pages.py as relations.
_PRS = """
pr as (
    select o_orderkey as k, 'org' || (o_custkey % 3) as owner, 'repo' || (o_custkey % 7) as name,
           owner || '/' || name as repo,
           'https://x/repos/' || repo || '/pulls/' || o_orderkey as url,
           cast(o_orderkey // 100 as integer) as page_no,
           o_orderdate + (o_orderkey % 86400) * interval 1 second as created_at,
           case when o_orderstatus <> 'O' then created_at + (o_orderkey * 37 % 90) * interval 1 day
                + (o_orderkey * 7919 % 86400) * interval 1 second end as closed_at,
           case when o_orderstatus = 'F' then closed_at end as merged_at
    from orders
),
pulls as (
    select k, owner, name, repo, url, page_no, 0 as version, 'open' as state, created_at,
           cast(null as timestamp) as closed_at, cast(null as timestamp) as merged_at, created_at as updated_at
    from pr
    union all
    select k, owner, name, repo, url, page_no, 1, 'closed', created_at, closed_at, merged_at, closed_at
    from pr where closed_at is not null
)"""

_LATEST = (
    _PRS
    + """,
latest as (
    select * from pulls qualify row_number() over (partition by url order by updated_at desc, version desc) = 1
)"""
)

def _marks_sql(stored: str) -> str:
    return (
        _PRS
        + f""",
stored as (select * from pulls where {stored}),
pages as (select owner, name, page_no, max(updated_at) as newest from pulls group by all),
marks as (
    select s.owner, s.name, 'etag-' || s.page_no as etag, s.updated_at
    from stored s join pages p on s.owner = p.owner and s.name = p.name and s.page_no = p.page_no
    qualify row_number() over (partition by s.owner, s.name
                               order by s.updated_at desc, p.newest desc, s.page_no desc) = 1
)"""
    )


_MARKS = _marks_sql(f"updated_at < timestamp '{STORED_BEFORE}' and owner <> 'org2'")


def _batches_sql(order: tuple = ((0, ()), (1, (0,)), (2, (0, 1))), bad: str = "false") -> str:
    """Runs one after another, each with the runs its marks come from; the first page below the mark ends a run.

    ``bad`` pages spoil the second run of their repository.
    """
    steps = []
    for n, earlier in order:
        start, tail, end = RUNS[n]
        reached = " union all ".join(f"select owner, name, newest from admitted{m}" for m in earlier) or (
            "select owner, name, timestamp '1970-01-01 00:00:00' as newest from pages"
        )
        steps.append(f""",
fetched{n} as (
    select 'run-{n}' as run_id, owner, name, items, newest,
           cast(page_no + case when newest < timestamp '{start}' then {TAIL} else 0 end as integer) as page_no
    from pages where newest >= timestamp '{tail}' and newest < timestamp '{end}'
),
run{n} as (
    select * from fetched{n} where (owner, name) not in (select (owner, name) from fetched{n} where {bad if n == 1 else "false"})
),
mark{n} as (select owner, name, max(newest) as mark from ({reached}) group by all),
stop{n} as (
    select r.owner, r.name, min(r.page_no) as first_stale from run{n} r
    join mark{n} m on r.owner = m.owner and r.name = m.name where r.newest < m.mark group by all
),
admitted{n} as (
    select r.* from run{n} r left join stop{n} s on r.owner = s.owner and r.name = s.name
    where s.first_stale is null or r.page_no < s.first_stale
)""")
    pages = ",\npages as (select owner, name, page_no, max(updated_at) as newest, count(*) as items from pulls group by all)"
    shown = "select run_id, owner, name as repo, page_no, items from admitted"
    return f"with {_PRS}{pages}{''.join(steps)}\n" + " union all ".join(f"{shown}{n}" for n, _ in order)


# Mean of epoch(age(merged_at, created_at)) / 86400 over the 30 days up to created_at, summed in whole microseconds.
_MEAN_AGE = """cast(sum(cast(round(epoch(age(merged_at, created_at)) * 1000000) as hugeint)) over recent as double)
           / count(age(merged_at, created_at)) over recent / 86400000000"""
_RECENT = """window recent as (
        partition by repo order by created_at
        range between interval 30 days preceding and current row)"""


def _list(repos: list[str]) -> str:
    return ", ".join(f"'{r}'" for r in repos)


def _rolling_sql(start: str, end: str, chosen: str = "true", repos: str | None = None) -> str:
    """``chosen`` filters pull requests by repo; ``repos`` is the calendar's list, else all chosen ones."""
    return (
        _LATEST
        + f""",
listed as ({repos or f"select distinct repo from pulls where {chosen}"}),
calendar as (
    select cast(unnest(generate_series(timestamp '{start}', timestamp '{end}', interval 1 day)) as date) as day
),
rolling as (
    select repo, url, created_at, cast(merged_at as date) as merged_date,
           {_MEAN_AGE} as duration
    from latest where merged_at is not null and {chosen}
    {_RECENT}
),
picks as (
    select * from rolling
    qualify row_number() over (partition by repo, merged_date order by created_at desc, url desc) = 1
),
durations as (
    select cast(c.day as varchar) as day, p.repo, avg(p.duration) as duration
    from (select day, repo from calendar cross join listed) c
    asof left join picks p on c.repo = p.repo and c.day >= p.merged_date
    group by c.day, p.repo
)"""
    )


def _closed_sql(start: str, end: str, chosen: str = "true") -> str:
    return (
        _LATEST
        + f""",
closed as (
    select url, repo, created_at, merged_at, updated_at, cast(cast(closed_at as date) as varchar) as closed_at
    from latest
    where latest.closed_at >= timestamp '{start}' and latest.closed_at <= timestamp '{end}' and {chosen}
)"""
    )


_WEEK = "cast(cast({0} as date) - cast(dayofweek(cast({0} as date)) as integer) as varchar)"

_EVENT_ASOF = """
with clicks as (select event_id, user_id, ts from events where event_type = 'click'),
purchases as (
    select event_id as purchase_id, user_id, ts as purchase_ts, value from events where event_type = 'purchase'
    qualify row_number() over (partition by user_id, ts order by event_id desc) = 1
)
"""

_BM25 = f"""
with words as (
    select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'),
                               lambda w: w <> '') as ws
    from documents
),
sized as (select doc_id, ws, len(ws) as length from words),
terms as (select unnest(['der', 'rest', 'of', 'that', 'house']) as term),
tf as (
    select doc_id, w as term, count(*) as tf from (select doc_id, unnest(ws) as w from words)
    where w in (select term from terms) group by doc_id, w
),
df as (select term, count(*) as df from tf group by term),
totals as (select count(*) as n, avg(length) as mean_length from sized),
scores as (
    select tf.doc_id, round(sum(
        ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) as score
    from tf join df on tf.term = df.term join sized on tf.doc_id = sized.doc_id, totals group by tf.doc_id
)
"""


def oracle_sql() -> dict[str, str]:
    shown = "url, repo, created_at, merged_at, updated_at, closed_at"
    some = f"repo in ({_list(SOME_REPOS)})"
    rest = f"repo not in ({_list(SOME_REPOS)})"
    sql = {
        "json_strict_shred": f"with {_PRS} select url, repo, state, created_at, closed_at, merged_at, updated_at, "
        "false as draft from pulls",
        "json_shred_report": f"""with {_PRS}, placed as (
                select *, cast(row_number() over (partition by owner, name, page_no order by k, version) - 1 as integer) as pos
                from pulls)
            select owner, name as repo, page_no, pos as item_pos, url, state, updated_at, cast(null as varchar) as error
            from placed where page_no % 10 not in (3, 5)
            union all select owner, name, page_no, pos, null, null, null, 'missing key draft'
            from placed where page_no % 10 = 5
            union all select distinct owner, name, page_no, null, null, null, null, 'not a readable JSON array'
            from placed where page_no % 10 = 3""",
        "json_path_extract": "select event_id, props ->> '$.k' as k from events",
        "json_build_metadata": f"""with {_PRS} select distinct owner, name as repo, page_no,
            cast(to_json({{owner: owner, repo: name,
                 etag: case when page_no % 10 <> 0 then 'etag-' || page_no end}}) as varchar) as metadata from pulls""",
        "metadata_path_extract": f"""with {_PRS} select distinct page_no, 'etag-' || page_no as etag
            from pulls where owner = 'org1' and name = 'repo3'""",
        "repo_id_concat": "select c_custkey, nullif(c_mktsegment, 'BUILDING') || '/' || c_name as repo from customer",
        "raw_scan": f"""with {_PRS} select distinct owner, name as repo, page_no, 'etag-' || page_no as etag,
            'github_rest_api' as data_source, 'pulls' as data_type from pulls""",
        "latest_per_key": f"with {_LATEST} select url, repo, state, updated_at from latest",
        "latest_event_per_user": """select user_id, event_id, event_type, ts from events
            qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""",
        "distinct_repos": f"with {_PRS} select distinct repo from pulls",
        "semi_join_repos": f"with {_PRS} select repo, url, updated_at from pulls where {some}",
        "semi_join_repo_table": f"""with {_PRS} select repo, url, updated_at from pulls where repo in (
            select 'org' || (c_custkey % 3) || '/repo' || (c_custkey % 7) as r from customer group by r
            having count_if(c_mktsegment = 'BUILDING') > count_if(c_mktsegment = 'MACHINERY'))""",
        "anti_join_excluded": f"with {_PRS} select repo, url, updated_at from pulls where {rest}",
        "calendar_spine": f"""with {_PRS},
            span as (select repo, min(created_at) as lo, max(created_at) as hi from pulls group by repo)
            select repo, cast(cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as varchar) as day from span""",
        "calendar_cross_repo": f"""with {_PRS} select repo, cast(cast(step as date) as varchar) as day
            from (select distinct repo from pulls),
                 (select unnest(generate_series(timestamp '{START}', timestamp '{END}', interval 1 day)) as step)""",
        "calendar_age_days": """select l_orderkey, l_linenumber,
            round(epoch(age(l_shipdate, o_orderdate)) / 86400, 6) as age_days,
            round(epoch(l_shipdate - o_orderdate) / 86400, 6) as elapsed_days
            from lineitem join orders on l_orderkey = o_orderkey""",
        "bin_day": """select cast(cast(ts as date) as varchar) as bin, event_type, count(*) as count
            from events group by all""",
        "bin_week_sunday": f"select {_WEEK.format('ts')} as bin, event_type, count(*) as count from events group by all",
        "date_range_presets": """
            with ranges(preset, days) as (values ('last_seven', 7), ('last_thirty', 30), ('last_ninety', 90),
                                                 ('last_three_sixty_five', 365), ('no_such_preset', 30)),
            bounds as (select preset, date '2001-06-15' - days as lo, date '2001-06-15' as hi from ranges)
            select preset, cast(lo as varchar) as start_day, cast(hi as varchar) as end_day, count(o_orderkey) as orders
            from bounds left join orders on o_orderdate >= lo and o_orderdate <= hi group by preset, lo, hi""",
        "rolling_avg_30d": f"""with {_LATEST} select url, repo, created_at,
            {_MEAN_AGE} as duration
            from latest where merged_at is not null {_RECENT}""",
        "rolling_avg_events_3d": """select event_id, event_type,
            cast(sum(cast(value as decimal(18, 2))) over w as double) / count(value) over w as mean_value from events
            window w as (partition by event_type order by ts range between interval 3 days preceding and current row)""",
        "rolling_avg_events_plain": """select event_id, user_id,
            cast(sum(cast(value as decimal(18, 2))) over w as double) / count(value) over w as mean_value from events
            window w as (partition by user_id order by ts range between interval 3 days preceding and current row)""",
        "asof_left_join": f"""{_EVENT_ASOF} select c.event_id, c.user_id, c.ts, p.purchase_id, p.purchase_ts, p.value
            from clicks c asof left join purchases p on c.user_id = p.user_id and c.ts >= p.purchase_ts""",
        "asof_window_join": f"""{_EVENT_ASOF} select c.event_id, c.user_id, c.ts, p.purchase_id, p.value
            from clicks c asof left join purchases p on c.user_id = p.user_id and c.ts >= p.purchase_ts""",
        "asof_forward_within_day": f"""{_EVENT_ASOF} select c.event_id, c.user_id, c.ts, p.purchase_id, p.value
            from clicks c asof join purchases p on c.user_id = p.user_id and c.ts < p.purchase_ts
            where p.purchase_ts - c.ts <= interval 1 day""",
        "merged_duration_rolling": f"with {_rolling_sql(START, END)} select day, repo, duration from durations",
        "merged_duration_rolling_repos": "with "
        + _rolling_sql(
            "1994-12-20 00:00:00",
            "1995-06-30 00:00:00",
            some,
            f"select unnest([{_list([*SOME_REPOS, SOME_REPOS[0], 'org9/unknown'])}]) as repo",
        )
        + " select day, repo, duration from durations",
        "merged_duration_rolling_excluded": f"with {_rolling_sql(SHORT_START, SHORT_END, rest)} "
        "select day, repo, duration from durations",
        "closed_items": f"with {_closed_sql(START, END)} select {shown} from closed",
        "closed_items_repos": f"with {_closed_sql(SHORT_START, SHORT_END, some)} select {shown} from closed",
        "closed_count_day": f"""with {_closed_sql(SHORT_START, SHORT_END)}
            select closed_at as bin, repo, count(*) as count from closed group by all""",
        "closed_count_week": f"""with {_closed_sql(START, END)}
            select {_WEEK.format('closed_at')} as bin, repo, count(*) as count from closed group by all""",
        "source_freshness": f"""with {_PRS} select max(updated_at) as updated_at,
            strftime(max(updated_at), '%Y-%m-%dT%H:%M:%SZ') as updated_at_text from pulls""",
        "overview": f"""with {_rolling_sql(SHORT_START, SHORT_END)},
            closed as (select * from latest where closed_at >= timestamp '{SHORT_START}'
                       and closed_at <= timestamp '{SHORT_END}')
            select 'duration' as chart, day, repo, duration as amount from durations
            union all
            select 'closed', cast(cast(closed_at as date) as varchar), repo, cast(count(*) as double)
            from closed group by cast(closed_at as date), repo""",
        "high_water_marks": f"with {_marks_sql('true')} select owner, name as repo, etag, updated_at from marks",
        "marks_or_default": f"""with {_MARKS} select r.owner, r.name as repo, coalesce(etag, '') as etag,
            coalesce(updated_at, timestamp '1970-01-01 00:00:00') as updated_at
            from (select distinct owner, name from pulls) r
            left join marks m on r.owner = m.owner and r.name = m.name""",
        "page_admission": f"""with {_MARKS},
            judged as (
                select p.owner, p.name, p.page_no,
                       p.newest >= coalesce(m.updated_at, timestamp '1970-01-01 00:00:00') as has_news
                from pages p left join marks m on p.owner = m.owner and p.name = m.name
            ),
            stops as (select owner, name, min(page_no) as first_stale from judged where not has_news group by all)
            select p.owner, p.name as repo, p.page_no, 'etag-' || p.page_no as etag
            from pages p left join stops s on p.owner = s.owner and p.name = s.name
            where s.first_stale is null or p.page_no < s.first_stale""",
        "repo_string_parse": f"with {_PRS} select distinct owner, name as repo from pulls",
        "stream_ingest_equals_batch": f"with {_LATEST} select url, repo, state, updated_at from latest",
        "ingest_once_batches": _batches_sql(),
        "stream_ingest_batches": _batches_sql(),
        "adhoc_sql_views": f"""with {_LATEST} select repo, count(*) as items, cast(count_if(state = 'open') as bigint) as open_items,
            count(distinct cast(created_at as date)) as days
            from latest where created_at >= timestamp '1997-01-01 00:00:00' group by repo""",
        "export_roundtrip": f"""with {_closed_sql(SHORT_START, SHORT_END)},
            counts as (select closed_at as bin, repo, count(*) as count from closed group by all)
            select format, bin, repo, count from counts, (select unnest(['parquet', 'csv', 'json']) as format)""",
        "export_arrow": f"with {_closed_sql(START, END)} select {shown} from closed",
        "closed_default_range": f"""with {_closed_sql("1997-05-16", "1997-06-15")}
            select closed_at as bin, repo, count(*) as count from closed group by all""",
        "closed_offset_range": f"""with {_closed_sql("1997-03-01 03:30:00", "1997-05-01 00:15:00")} select {shown} from closed""",
        "merged_duration_ordered": f"""with {_rolling_sql(SHORT_START, SHORT_END)}
            select day, repo, duration, row_number() over (order by day, repo nulls last) - 1 as position from durations""",
        "stream_ingest_bad_run": _batches_sql(bad="owner = 'org1' and page_no % 5 = 0"),
        "stream_keyed_progress": f"select run_id, owner, repo, page_no from ({_batches_sql()})",
        "retried_run": _batches_sql(order=((0, ()), (2, (0,)), (1, (0,)))),
        "stream_ingest_files": f"""with {_PRS} select distinct owner, name as repo, page_no, 'etag-' || page_no as etag,
            cast(to_json({{owner: owner, repo: name, etag: 'etag-' || page_no}}) as varchar) as metadata from pulls""",
        "bm25_scan": f"{_BM25} select doc_id, score from scores",
        "bm25_scan_search": f"{_BM25} select doc_id, score from scores order by score desc, doc_id limit 10",
        "bm25_scores": f"{_BM25} select doc_id, score from scores",
        "bm25_search": f"{_BM25} select doc_id, score from scores order by score desc, doc_id limit 10",
    }
    sql |= {"store_freshness": sql["source_freshness"], "overview_kept": sql["overview"], "merged_duration_incremental": sql["merged_duration_rolling"]}
    for name, (text, tables) in ADHOC.items():
        sql[name] = text.format(**{table: table for table in tables})
    return sql | _llm()[1]
