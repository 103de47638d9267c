"""Work that must not grow faster than the input: what is shuffled, listed and read again."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__ as entry
from mergetide.functions.json_shred import JsonField, shred
from mergetide.plans.rolling_state import update_points
from mergetide.schemas import LANDED_PAGE, PULL_FIELDS
from mergetide.session import configure
from mergetide.sources import ingest
from mergetide.sources.commits import claim_number
from mergetide.sources.compaction import merge_batches, read_current
from mergetide.sources.ingest import ingest_once, set_aside
from mergetide.sources.landing import land_files, read_landed
from mergetide.sources.order_pages import order_pages
from mergetide.sources.tables import Store, read_failed, read_raw
from tests.helpers import plan, pr, rows

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz"


def _orders(spark):
    day = datetime(1997, 1, 31)
    rows = [(205, 1, "F", day), (201, 22, "O", day), (205, 1, "F", day), (None, None, None, None), (250, 1, "P", day), (7, 2, "F", None)]
    return spark.createDataFrame(rows, ORDERS)


def _landed(spark):
    rows = [
        ("run 1/x", "o%C3", "r+1", 3, 'W/"etag:1"', "1997-01-31T00:00:00Z", "[]"),
        ("run-0", "o", "r", 4, "", "1997-01-31T00:00:00Z", '[{"ü": 1}]'),
        ("run-0", None, "r", 5, "e", "1997-01-31T00:00:00Z", None),
    ]
    return spark.createDataFrame(rows, LANDED_PAGE)


def test_page_text_is_made_behind_the_shuffle(spark):
    made = plan(order_pages(_orders(spark)))
    assert made.count("Exchange") == 1
    assert "Aggregate" in made[: made.index("Exchange")] and "Aggregate" not in made[made.index("Exchange") :]


def test_pages_of_orders(spark):
    pages = {(r.owner, r.repo, r.page_no): r for r in order_pages(_orders(spark)).collect()}
    assert set(pages) == {("org1", "repo1", 2), (None, None, None), ("org2", "repo2", 0)}
    page = pages["org1", "repo1", 2]
    items = json.loads(page.body)
    assert [(i["number"], i["state"]) for i in items] == [
        (201, "open"), (205, "open"), (205, "open"), (205, "closed"), (205, "closed"), (250, "open"), (250, "closed")
    ]
    assert list(items[0]) == ["url", "number", "base", "state", "created_at", "updated_at", "closed_at", "merged_at", "draft", "user"]
    assert items[3]["base"] == {"repo": {"name": "repo1", "owner": {"login": "org1"}}}
    assert items[3]["merged_at"] == items[3]["closed_at"] == items[3]["updated_at"] and items[6]["merged_at"] is None
    assert page.fetched_at == max(i["updated_at"] for i in items) and page.etag == "etag-2"


def test_landing_is_compressed(spark, tmp_path):
    entry._land(_landed(spark), str(tmp_path / "landing"))
    assert {p.suffix for p in (tmp_path / "landing").glob("part-*")} == {".gz"}
    assert sorted(read_landed(spark, str(tmp_path / "landing")).collect(), key=str) == sorted(_landed(spark).collect(), key=str)


def test_plain_files_land_where_sparks_partitions_would(spark, tmp_path):
    told = ["run_id", "owner", "repo", "page_no", "etag"]
    _landed(spark).selectExpr(*told, "body as value").write.partitionBy(*told).text(str(tmp_path / "spark"))
    land_files(_landed(spark), str(tmp_path / "own"))

    def found(name: str) -> dict[str, str]:
        return {str(p.parent.relative_to(tmp_path / name)): p.read_text() for p in Path(tmp_path / name).rglob("[!._]*") if p.is_file()}

    assert found("own") == found("spark") and len(found("own")) == 3


def test_folders_are_listed_by_few_tasks(spark):
    configure(spark)
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) <= 200


def test_page_files_are_read_once(spark, tmp_path, monkeypatch):
    store = Store(str(tmp_path / "store"))
    land_files(_landed(spark).where("page_no = 4").selectExpr("run_id", "owner", "repo", "page_no", "etag", "'[]' as body"), str(tmp_path / "in"))
    stage, opened = ingest._stage, []
    monkeypatch.setattr(ingest, "_stage", lambda df, store, name: (opened.append(name), stage(df, store, name))[1])
    number = ingest_once(spark, str(tmp_path / "in"), store, layout="files", on_error="quarantine")
    assert opened[0] == f"landed-{number}"
    assert not (tmp_path / "store" / "staged" / f"landed-{number}").exists()
    assert read_raw(spark, store).count() == 0


def test_pages_set_aside_are_not_shuffled_by_their_batch(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    set_aside(_landed(spark), store, claim_number(spark, store.home, "test"), "out of reach")
    assert "Exchange" not in plan(read_failed(spark, store))
    assert read_failed(spark, store).count() == 3


def _landed_pulls(spark, number, *items):
    page = (f"run-{number}", "o", "r", 1, "e", f"2024-01-0{number}T00:00:00Z", json.dumps(items))
    return spark.createDataFrame([page], LANDED_PAGE)


def test_an_item_is_read_once_for_all_its_members(spark):
    body = json.dumps([pr(1, "2024-01-01T00:00:00Z"), pr(2, "2024-01-02T00:00:00Z", base=None)])
    pages = spark.createDataFrame([(body,)], "body string")
    for on_error in ("raise", "report"):
        items = shred(pages, "body", PULL_FIELDS, on_error=on_error)
        assert "try_variant_get" in items._jdf.queryExecution().analyzed().toString()
        assert [(r.item_pos, r.name, r.login, r.closed_at) for r in items.orderBy("item_pos").collect()] == [(0, "r", "o", None), (1, None, None, None)]


def test_members_within_others_and_differing_by_case(spark):
    fields = [JsonField(f"f{n}", path, "string") for n, path in enumerate(("a", "a.b", "c.d", "C.e", "g", "g.h`i"))]
    pages = spark.createDataFrame([('[{"a": {"b": 1}, "c": {"d": "x"}, "C": {"e": null}, "g": {"h`i": [1]}}]',), ('[{"a": {"b": 1}}]',)], "body string")
    good, bad = shred(pages, "body", fields, on_error="report").orderBy(F.desc("f0")).collect()
    assert good[1:] == ('{"b":1}', "1", "x", None, '{"h`i":[1]}', "[1]", None) and bad.error == "missing key c.d"


def test_versions_are_read_without_joins(spark, tmp_path):
    store = Store(str(tmp_path), buckets=2)
    for number, items in enumerate([[pr(1, "2024-01-01T00:00:00Z"), pr(2, "2024-01-01T00:00:00Z")], [pr(2, "2024-01-01T00:00:00Z", "2024-01-03T00:00:00Z")]], 1):
        ingest.ingest_batch(_landed_pulls(spark, number, *items), store, number)
        if number == 1:
            merge_batches(spark, store)
    current = read_current(spark, store)
    assert "Join" not in plan(current.versions())
    assert rows(current.versions().select("url", "updated_at")) == rows(current.settled.unionByName(current.open).select("url", "updated_at"))
    assert current.versions().count() == 3


def test_sound_pages_are_not_read_to_be_set_aside(spark, tmp_path, monkeypatch):
    store, written = Store(str(tmp_path)), {}

    def write(df, store, table, batch_id):
        written[table] = plan(df)
        write_batch(df, store, table, batch_id)

    write_batch = ingest.write_batch
    monkeypatch.setattr(ingest, "write_batch", write)
    page = _landed_pulls(spark, 1, pr(1, "2024-01-01T00:00:00Z"))
    set_aside(page, store, 1, "tried before")
    (tmp_path / "commits/b0000001").unlink()
    ingest.ingest_batch(page, store, 1, "isolate")
    assert "Join" not in written[ingest.FAILED_TABLE] and read_failed(spark, store).count() == 0
    assert read_raw(spark, store).count() == 1


def test_latest_merges_are_told_once_in_an_update(spark, tmp_path):
    store = Store(str(tmp_path))
    ingest.ingest_batch(_landed_pulls(spark, 1, pr(1, "2024-01-01T00:00:00Z", closed="2024-01-02T00:00:00Z", merged="2024-01-02T00:00:00Z")), store, 1)
    assert update_points(spark, store)
    (kept,) = (tmp_path / "rolling/staged").glob("*/merges")
    assert spark.read.parquet(str(kept)).count() == 1
