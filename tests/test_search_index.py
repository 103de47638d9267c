"""The stored index against a scan of the texts, batch by batch."""

import pytest
from pyspark.sql import functions as F

from mergetide.operators.search import bm25, query_terms
from mergetide.sources import commits, search_index
from mergetide.sources.search_index import SearchIndex, add_documents, document_postings, merge_batches, score_documents
from tests.helpers import plan, rows

TEXTS = ["The house, the OLD house", "", None, "an old tree", "Straße 12 und strasse", "the " * 50, "tree house tree", "Écoute ! écoute", "old" * 3]
QUERY = "Old HOUSE, house écoute 12"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "d long, body string, term string").repartition(3)


def scores(df):
    return {r[0]: round(r[1], 9) for r in df.collect()}


def test_postings(docs):
    got = {}
    for r in document_postings(docs, "d", "body").collect():
        got.setdefault(r.id, []).append((r.place, r.term, r.tf, r.length))
    assert sorted(got[0]) == [(0, "house", 2, 5), (1, "old", 1, 5), (2, "the", 2, 5)]
    assert got[1] == got[2] == [(0, None, None, 0)] and got[5] == [(0, "the", 50, 50)]


def test_equal_to_a_scan_in_any_batches(spark, docs, tmp_path):
    want = scores(bm25(docs, "d", "body", QUERY))
    assert len(want) == 5
    for cuts in (1, 2, 4):
        index = SearchIndex(str(tmp_path / f"i{cuts}"), buckets=5)
        for n in range(cuts):
            assert add_documents(docs.where(F.col("d") % cuts == n), index, "d", "body", "loader", n) == n
            before = scores(score_documents(spark, index, QUERY))
            add_documents(docs.where(F.col("d") % cuts == n), index, "d", "body", "loader", n)  # counts once
            assert scores(score_documents(spark, index, QUERY)) == before
            assert before == scores(bm25(docs.where(F.col("d") % cuts <= n), "d", "body", QUERY))
        assert before == want
        assert merge_batches(spark, index) == (cuts > 1)
        assert scores(score_documents(spark, index, QUERY)) == want
        assert len(commits.parts(spark, index.home).live) == 1


def test_queries_without_words_or_documents(spark, docs, tmp_path):
    index = SearchIndex(str(tmp_path / "i"))
    assert score_documents(spark, index, QUERY).count() == 0
    add_documents(docs.where("false"), index, "d", "body")
    assert score_documents(spark, index, QUERY).count() == 0
    add_documents(docs.withColumn("d", F.when(F.col("d") > 0, F.col("d"))), index, "d", "body")  # one row without id
    assert score_documents(spark, index, " ,;").count() == score_documents(spark, index, "nowhere").count() == 0
    assert 0 not in scores(score_documents(spark, index, QUERY))
    assert query_terms(spark, "A a, b!") == ["a", "b"]


def test_broken_batches_are_not_seen(spark, docs, tmp_path, monkeypatch):
    index = SearchIndex(str(tmp_path / "i"))
    with monkeypatch.context() as broken:
        broken.setattr(search_index.commits, "commit_batch", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            add_documents(docs, index, "d", "body", "loader", 0)
    assert score_documents(spark, index, QUERY).count() == 0
    add_documents(docs, index, "d", "body", "loader", 0)
    assert scores(score_documents(spark, index, QUERY)) == scores(bm25(docs, "d", "body", QUERY))


def test_a_query_opens_its_own_folders(spark, docs, tmp_path):
    index = SearchIndex(str(tmp_path / "i"), buckets=64)
    add_documents(docs, index, "d", "body")
    text = plan(score_documents(spark, index, "tree"))
    scan = next(s for s in text.split("FileScan parquet")[1:] if "term" in s.split("PushedFilters")[0])
    assert "bucket" in scan.split("PartitionFilters:")[1].split("]")[0] and "EqualTo(term,tree)" in scan
    assert "body" not in text and "NestedLoop" not in text
    assert rows(score_documents(spark, index, "tree").select("id")) == [(3,), (6,)]
