from datetime import datetime

import pytest

from mergetide.functions.json_shred import JsonField, json_object, json_text, repo_id, shred
from mergetide.plans.metrics import pulls_from_raw, raw_freshness, repos_in_raw
from tests.helpers import pr, raw_table, rows

A = JsonField("a", "a", "string")
B = JsonField("b", "b", "string")
T = JsonField("t", "t", "timestamp_ntz")
NAME = JsonField("name", "base.repo.name", "string")


def run(spark, text, *fields, **options):
    return shred(spark.createDataFrame([(text,)], "data string"), "data", fields, **options)


ACCEPTED = [
    ('[{"a":"x","z":1}]', [A], [(0, "x")]),
    (' \n[ {"a":"x"} ]', [A], [(0, "x")]),
    ('[{"b":null}]', [B], [(0, None)]),
    ('[{"b":5}]', [B], [(0, "5")]),
    ('[{"b":true}]', [JsonField("b", "b", "boolean")], [(0, True)]),
    ('[{"base":null}]', [NAME], [(0, None)]),
    ('[{"base":{"repo":null}}]', [NAME], [(0, None)]),
    ('[{"base":{"repo":{"name":"n","x":2}},"head":{"repo":{"name":"other"}}}]', [NAME], [(0, "n")]),
    ('[null,{"a":"x"}]', [A], [(0, None), (1, "x")]),
    ('[{"t":"2022-03-09T10:45:30Z"}]', [T], [(0, datetime(2022, 3, 9, 10, 45, 30))]),
    ("[]", [A], []),
    (" [ ] ", [A], []),
    ("null", [A], []),
    (None, [A], []),
]

REFUSED = [
    ('[{"a":"x"}]', [A, B]),
    ('[{"a":"x","a":"y"}]', [A]),
    ('[{"t":"zz"}]', [T]),
    ('{"b":"5"}', [B]),
    ("{}", [B]),
    ('[{"b":', [B]),
    ("", [B]),
    ("5", [B]),
    ("[5]", [B]),
    ("[[1]]", [B]),
    ('[{"base":{"repo":{}}}]', [NAME]),
    ('[{"base":{}}]', [NAME]),
    ('[{"base":5}]', [NAME]),
    ('[{"x":{"repo":{"name":"n"}}}]', [NAME]),
]


@pytest.mark.parametrize("text,fields,expected", ACCEPTED)
def test_accepted(spark, text, fields, expected):
    assert rows(run(spark, text, *fields)) == expected
    reported = run(spark, text, *fields, on_error="report")
    assert rows(reported) == [(*r, None) for r in expected]


@pytest.mark.parametrize("text,fields", REFUSED)
def test_refused(spark, text, fields):
    with pytest.raises(Exception):
        run(spark, text, *fields).collect()
    reported = run(spark, text, *fields, on_error="report").collect()
    assert len(reported) == 1 and reported[0]["error"]
    assert all(reported[0][f.name] is None for f in fields)


def test_checks_survive_pruning_and_filters(spark):
    """count(), unread columns and filters on other columns do not skip the checks."""
    missing = '[{"a":null}]'
    for query in (
        lambda df: df.count(),
        lambda df: df.select("a").collect(),
        lambda df: df.where("a is not null").collect(),
        lambda df: df.where("item_pos > 5").collect(),
    ):
        with pytest.raises(Exception):
            query(run(spark, missing, A, B))
    with pytest.raises(Exception):  # a bad cast in a column nobody reads
        run(spark, '[{"a":"x","t":"zz"}]', A, T).select("a").collect()


def test_keep_empty(spark):
    data = [("p1", "[]"), ("p2", None), ("p3", '[{"a":"x"}]')]
    pages = spark.createDataFrame(data, "page string, data string")
    kept = shred(pages, "data", [A], keep=["page"], keep_empty=True)
    assert rows(kept) == [("p1", None, None), ("p2", None, None), ("p3", 0, "x")]
    reported = shred(pages, "data", [A], keep=["page"], keep_empty=True, on_error="report")
    assert rows(reported) == [("p1", None, None, None), ("p2", None, None, None), ("p3", 0, "x", None)]


def test_full_pull_request(spark):
    item = pr(
        58, "2022-03-07T08:15:00Z", closed="2022-03-09T10:45:30Z", merged="2022-03-09T10:45:30Z",
        owner="tidal", name="harbour",
        milestone={"created_at": "2022-02-01T00:00:01Z", "closed_at": "2022-05-05T05:05:05Z"},
        head={"repo": {"name": "fork", "owner": {"login": "someone"}}}, labels=[{"id": 1}], assignees=[],
    )
    raw = raw_table(spark, [item])
    (row,) = pulls_from_raw(raw).collect()
    assert row["repo"] == "tidal/harbour"
    assert row["merged_at"] == datetime(2022, 3, 9, 10, 45, 30)
    assert row["created_at"] == datetime(2022, 3, 7, 8, 15)
    assert row["draft"] is False and row["raw_id"] == 0 and row["etag"] == "e0"
    assert rows(repos_in_raw(raw)) == [("tidal/harbour",)]
    assert raw_freshness(raw).first()["updated_at_text"] == "2022-03-09T10:45:30Z"


def test_commit_payload_is_refused(spark):
    commit = {"sha": "0a1b2c", "commit": {"message": "Dredge the channel"}, "author": {"login": "tidal"}}
    with pytest.raises(Exception):
        pulls_from_raw(raw_table(spark, [commit])).collect()


def test_null_names_are_skipped(spark):
    item = pr(1, "2024-01-01T00:00:00Z", base=None)
    assert rows(repos_in_raw(raw_table(spark, [item]))) == []
    assert pulls_from_raw(raw_table(spark, [item])).first()["repo"] is None


def test_json_helpers(spark):
    df = spark.createDataFrame([("o", None, 'x"y')], "owner string, repo string, etag string")
    built = df.select(json_object(owner="owner", repo="repo", etag="etag").alias("m"), repo_id("owner", "repo").alias("i"))
    assert built.first()["m"] == '{"owner":"o","repo":null,"etag":"x\\"y"}'
    assert built.first()["i"] is None
    assert built.select(json_text("m", "$.etag").alias("e"), json_text("m", "$.no").alias("n")).first() == ('x"y', None)


def test_odd_paths_are_refused():
    with pytest.raises(ValueError):
        JsonField("x", "a'b", "string")
