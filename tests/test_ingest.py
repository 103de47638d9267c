import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mergetide.plans import metrics
from mergetide.schemas import LANDED_PAGE
from mergetide.sources.admission import admit, page_news, run_cutoffs
from mergetide.sources.ingest import append_pages, ingest_batch, ingest_once
from mergetide.sources.landing import parse_repos, read_landed
from mergetide.sources.marks import high_water_marks, latest_marks, marks_or_default
from mergetide.sources.tables import Store, read_marks, read_pulls, read_quarantine, read_raw
from mergetide.streaming.ingest import start_ingest
from tests.helpers import plan, pr, rows, ts

MARK = "owner string, repo string, etag string, updated_at timestamp_ntz"


def page(run, number, *items, owner="o", repo="r", body=None):
    text = json.dumps(list(items)) if body is None else body
    return (run, owner, repo, number, f"{run}-{number}", "2024-06-01T00:00:00Z", text)


def item(number, updated, **more):
    return pr(number, "2024-01-01T00:00:00Z", updated=f"{updated}T00:00:00Z", **more)


def landed(spark, *pages):
    return spark.createDataFrame(list(pages), LANDED_PAGE)


def admitted(spark, news, mark=None):
    """Pages as (number, newest update) of one run -> numbers of those admitted."""
    data = [("run", "o", "r", number, ts(newest)) for number, newest in news]
    items = spark.createDataFrame(data, "run_id string, owner string, repo string, page_no int, updated_at timestamp_ntz")
    marks = spark.createDataFrame([("o", "r", "e", ts(mark))] if mark else [], MARK)
    cutoffs = run_cutoffs(page_news(items), marks)
    return sorted(r["page_no"] for r in admit(items.drop("updated_at"), cutoffs).collect())


def test_admission(spark):
    mark = "2024-02-01"
    assert admitted(spark, [(1, "2024-03-02"), (2, "2024-03-01"), (3, "2024-01-01"), (4, "2024-03-01")], mark) == [1, 2]
    assert admitted(spark, [(1, mark)], mark) == [1]  # the page that holds the mark
    assert admitted(spark, [(1, "2024-01-31 23:59:59")], mark) == []
    assert admitted(spark, [(1, "2024-03-01"), (2, None), (3, "2024-03-01")], mark) == [1]  # an empty page ends it
    assert admitted(spark, [(1, "1971-01-01"), (2, "1970-01-01")]) == [1, 2]  # nothing stored
    assert admitted(spark, [(1, "1969-12-31")]) == []


def test_marks(spark):
    store_rows = [
        ("o", "a", "old", ts("2024-01-01"), ts("2024-01-02"), 1),
        ("o", "a", "seen twice, first", ts("2024-01-05"), ts("2024-01-06"), 2),
        ("o", "a", "seen twice, last", ts("2024-01-05"), ts("2024-01-07"), 3),
        ("o", "a", "undated", None, ts("2024-01-08"), 4),
        ("o", "b", "b", ts("2024-01-03"), ts("2024-01-03"), 5),
        (None, "b", "lost", ts("2024-01-09"), ts("2024-01-09"), 6),
    ]
    schema = "page_owner string, page_repo string, etag string, updated_at timestamp_ntz, raw_created_at timestamp_ntz, raw_id long"
    marks = high_water_marks(spark.createDataFrame(store_rows, schema))
    assert {(r["owner"], r["repo"]): (r["etag"], r["updated_at"]) for r in marks.collect()} == {
        ("o", "a"): ("seen twice, last", ts("2024-01-05")),
        ("o", "b"): ("b", ts("2024-01-03")),
    }
    asked = spark.createDataFrame([("o", "b"), ("o", "new")], "owner string, repo string")
    assert rows(marks_or_default(asked, marks)) == [
        ("o", "b", "b", ts("2024-01-03")),
        ("o", "new", "", datetime(1970, 1, 1)),
    ]


def test_repo_strings(spark):
    def parse(text):
        return parse_repos(spark.createDataFrame([(text,)], "repo string"))

    assert rows(parse("a/b")) == [("a", "b")]
    assert rows(parse("a/")) == [("a", "")]
    for wrong in ("a", "a/b/c", ""):
        with pytest.raises(Exception):
            parse(wrong).collect()
        with pytest.raises(Exception):
            parse(wrong).count()


def test_two_runs_and_a_repeated_batch(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    first = landed(
        spark,
        page("r1", 1, item(1, "2024-03-03"), item(2, "2024-03-02")),
        page("r1", 2, item(3, "2024-03-01")),
        page("r1", 1, item(1, "2024-02-02", owner="p"), owner="p"),
    )
    ingest_batch(first, store, 0)
    assert read_raw(spark, store).count() == 3 and read_pulls(spark, store).count() == 4

    second = landed(
        spark,
        page("r2", 1, item(4, "2024-03-05"), item(1, "2024-03-04")),
        page("r2", 2, item(2, "2024-03-03"), item(5, "2024-01-01")),  # at the mark: kept whole, late item included
        page("r2", 3, item(3, "2024-03-01")),  # no news
        page("r2", 4, item(6, "2024-03-09")),  # not fetched any more
        page("r2", 1, owner="p"),
    )
    for _ in range(2):  # as after a crash before the batch was noted as done
        ingest_batch(second, store, 1)
        raw = read_raw(spark, store)
        kept = raw.where("batch_id = 1").select("owner", "run_id", "page_no")
        assert rows(kept) == [("o", "r2", 1), ("o", "r2", 2)]
        assert raw.select("id").distinct().count() == raw.count() == 5
        assert read_pulls(spark, store).count() == 8
    marks = latest_marks(read_marks(spark, store))
    assert {(r["owner"], r["etag"], r["updated_at"]) for r in marks.collect()} == {
        ("o", "r2-1", ts("2024-03-05")),
        ("p", "r1-1", ts("2024-02-02")),
    }
    assert latest_marks(read_marks(spark, store), before=1).where("owner = 'o'").first()["updated_at"] == ts("2024-03-03")
    latest = metrics.latest_pulls(read_pulls(spark, store)).where("page_owner = 'o'")
    assert {r["url"][-1]: r["updated_at"] for r in latest.collect()} == {
        "1": ts("2024-03-04"), "2": ts("2024-03-03"), "3": ts("2024-03-01"), "4": ts("2024-03-05"), "5": ts("2024-01-01"),
    }
    # The shredded table says what shredding the raw one says.
    columns = ["url", "repo", "state", "created_at", "closed_at", "updated_at", "draft", "raw_id", "item_pos", "etag"]
    assert rows(metrics.pulls_from_raw(read_raw(spark, store)).select(columns)) == rows(
        read_pulls(spark, store).select(columns)
    )
    meta = read_raw(spark, store).where("batch_id = 0 and owner = 'p'").first()
    assert meta["metadata"] == '{"owner":"p","repo":"r","etag":"r1-1"}' and meta["loaded_at"] is None
    assert (meta["data_source"], meta["data_type"]) == ("github_rest_api", "pulls")


def test_several_runs_in_one_batch(spark, tmp_path):
    """Each run starts from what the runs before it have reached."""
    store = Store(str(tmp_path / "store"))
    pages = landed(
        spark,
        page("r1", 1, item(1, "2024-03-03")),
        page("r1", 2, item(2, "2024-03-01")),
        page("r2", 1, item(1, "2024-03-03")),
        page("r2", 2, item(2, "2024-03-01")),
        page("r3", 1, item(3, "2024-03-02")),
    )
    ingest_batch(pages, store, 0)
    kept = read_raw(spark, store).select("run_id", "page_no")
    assert rows(kept) == [("r1", 1), ("r1", 2), ("r2", 1)]


def test_bad_pages(spark, tmp_path):
    pages = landed(
        spark,
        page("r1", 1, item(1, "2024-03-03")),
        page("r1", 2, item(2, "2024-03-02"), {"url": "incomplete"}),
        page("r1", 3, body="[{"),
        page("r1", 4, item(4, "2024-03-01")),
    )
    with pytest.raises(Exception):
        ingest_batch(pages, Store(str(tmp_path / "strict")), 0)
    store = Store(str(tmp_path / "lenient"))
    ingest_batch(pages, store, 0, on_error="quarantine")
    assert rows(read_raw(spark, store).select("page_no")) == [(1,), (4,)]
    bad = {r["page_no"]: r["error"] for r in read_quarantine(spark, store).collect()}
    assert bad == {2: "missing key base.repo.name", 3: "not a readable JSON array"}
    assert read_quarantine(spark, store).where("page_no = 3").first()["body"] == "[{"


def test_unreadable_lines(spark, tmp_path):
    good = page("r1", 1, item(1, "2024-03-03"))
    landed(spark, good).write.json(str(tmp_path / "landing"))
    (tmp_path / "landing" / "broken.json").write_text('{"run_id": "r1", "own\n{"run_id": "r1", "body": "[]"}\n')
    with pytest.raises(Exception):
        ingest_once(spark, str(tmp_path / "landing"), Store(str(tmp_path / "strict")))
    store = Store(str(tmp_path / "lenient"))
    start_ingest(spark, str(tmp_path / "landing"), store, interval=None).awaitTermination(120)
    assert rows(read_raw(spark, store).select("page_no")) == [(1,)]
    lost = sorted(r["body"] for r in read_quarantine(spark, store).collect())
    assert lost == ["page without a name: []", 'page without a name: {"run_id": "r1", "own']


def test_nothing_landed(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    ingest_batch(spark.createDataFrame([], LANDED_PAGE), store, 0)
    assert read_raw(spark, store).count() == read_pulls(spark, store).count() == 0
    assert latest_marks(read_marks(spark, store)).count() == 0


def test_landing_layouts(spark, tmp_path):
    pages = [page("007", 1, item(1, "2024-03-03")), page("007", 2, item(2, "2024-03-02"))]
    landed(spark, *pages).write.json(str(tmp_path / "envelopes"))
    for run, owner, repo, number, _, _, body in pages:
        folder = tmp_path / "files" / f"run_id={run}" / f"owner={owner}" / f"repo={repo}" / f"page_no={number}"
        folder.mkdir(parents=True)
        (folder / "page.json").write_text(json.dumps(json.loads(body), indent=1))  # text over several lines
    both = [read_landed(spark, str(tmp_path / "envelopes")), read_landed(spark, str(tmp_path / "files"), "files")]
    found = [rows(df.select("run_id", "owner", "repo", "page_no", F.get_json_object("body", "$[0].url"))) for df in both]
    assert found[0] == found[1] and found[0][0][0] == "007"
    stores = [Store(str(tmp_path / "s1")), Store(str(tmp_path / "s2"))]
    assert ingest_once(spark, str(tmp_path / "envelopes"), stores[0]) == 0
    assert ingest_once(spark, str(tmp_path / "files"), stores[1], layout="files") == 0
    pulls = [rows(read_pulls(spark, s).select("url", "updated_at")) for s in stores]
    assert pulls[0] == pulls[1] and len(pulls[0]) == 2
    assert ingest_once(spark, str(tmp_path / "envelopes"), stores[0]) == 1


def test_stream_equals_batch(spark, tmp_path):
    runs = [
        [page("r1", 1, item(1, "2024-03-03")), page("r1", 2, item(2, "2024-03-01"))],
        [page("r2", 1, item(3, "2024-03-05")), page("r2", 2, item(1, "2024-03-03")), page("r2", 3, item(2, "2024-03-01"))],
        [page("r3", 1, item(3, "2024-03-05"))],
    ]
    stream, batch = Store(str(tmp_path / "stream")), Store(str(tmp_path / "batch"))
    for number, run in enumerate(runs):
        landed(spark, *run).coalesce(1).write.mode("append").json(str(tmp_path / "landing"))
        query = start_ingest(spark, str(tmp_path / "landing"), stream, interval=None)
        query.awaitTermination(120)
        assert query.exception() is None
        ingest_batch(landed(spark, *run), batch, number)
    columns = ["url", "updated_at", "etag", "batch_id"]
    assert rows(read_pulls(spark, stream).select(columns)) == rows(read_pulls(spark, batch).select(columns))
    kept = [("r1", 1), ("r1", 2), ("r2", 1), ("r2", 2), ("r3", 1)]
    assert rows(read_raw(spark, stream).select("run_id", "page_no")) == kept


def test_other_sources_are_not_opened(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    append_pages(landed(spark, page("r1", 1, item(1, "2024-03-03"))), store, 0)
    scan = plan(read_raw(spark, store).select("etag"))
    assert "data_source" in scan.split("PartitionFilters:")[1].split("]")[0]
    assert "ReadSchema: struct<etag:string>" in scan
    assert read_raw(spark, store, data_type="commits").count() == 0


def _land(spark, folder, rows):
    fields = "run_id string, owner string, repo string, page_no int, etag string, fetched_at string, body string"
    spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").json(str(folder))


def _page(run, number, time, fetched):
    return (run, "o", "r", 1, "e", fetched, json.dumps([pr(number, "2019-12-01T00:00:00Z", updated=time)]))


def test_once_then_stream_on_one_store_keeps_both(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    _land(spark, tmp_path / "a", [_page("1", 1, "2020-01-01T00:00:00Z", "2020-01-02T00:00:00Z")])
    _land(spark, tmp_path / "b", [_page("2", 2, "2020-02-01T00:00:00Z", "2020-02-02T00:00:00Z")])
    ingest_once(spark, str(tmp_path / "a"), store)
    start_ingest(spark, str(tmp_path / "b"), store, interval=None).awaitTermination()
    assert sorted(r.run_id for r in read_raw(spark, store).collect()) == ["1", "2"]
    assert read_pulls(spark, store).count() == 2


def test_runs_of_a_batch_follow_their_fetch_time(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    rows = [
        _page("9", 1, "2020-01-01T00:00:00Z", "2020-01-02T00:00:00Z"),
        _page("10", 2, "2020-02-01T00:00:00Z", "2020-02-02T00:00:00Z"),
    ]
    _land(spark, tmp_path / "a", rows)
    ingest_once(spark, str(tmp_path / "a"), store)
    assert sorted(r.run_id for r in read_raw(spark, store).collect()) == ["10", "9"]


def test_quarantined_batches_keep_their_numbers(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    for run in ("1", "2"):
        _land(spark, tmp_path / run, [(run, "o", "r", 1, "e", "2020-01-02T00:00:00Z", '[{"url": 1}]')])
        ingest_once(spark, str(tmp_path / run), store, on_error="quarantine")
    assert sorted(r.run_id for r in read_quarantine(spark, store).collect()) == ["1", "2"]


def test_an_unreadable_time_sets_its_page_aside(spark, tmp_path):
    good, bad = page("r1", 1, item(1, "2024-03-03")), list(page("r2", 2, item(2, "2024-03-04")))
    bad[5] = "yesterday"
    store = Store(str(tmp_path / "store"))
    ingest_batch(landed(spark, good, tuple(bad)), store, 0, on_error="quarantine")
    assert rows(read_raw(spark, store).select("run_id")) == [("r1",)]
    (aside,) = read_quarantine(spark, store).collect()
    assert aside["run_id"] == "r2" and aside["body"].startswith("page with an unreadable time yesterday: [{")
