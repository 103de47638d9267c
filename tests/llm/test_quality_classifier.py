"""The discriminant against a dense computation, and its accuracy on documents it has not seen."""

import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mergetide.llm import quality_classifier as qc
from mergetide.llm import queries

SF_DIR = "/root/testdata/sf0.01"
GOOD = ["the house, by the sea. Old trees stand there", "a word and another one. They go on", "Nothing much is said here, but it is said well."]
BAD = ["BUY!! NOW!! BUY!! NOW!!", "a$$$ b### c%%% d&&& e***", "one | two | three | four |", "the the the the the the of of of of"]
SCHEMA = "doc_id long, text string, lang string, score double, x string"


def table(spark):
    texts = [f"{GOOD[i % 3]} {i} {GOOD[i % 2]}" if i % 4 else f"{BAD[i // 4 % 4]} {i}" for i in range(120)]
    rows = [(i, t, "en", 0.5, "x") for i, t in enumerate(texts)] + [(200, None, None, None, None), (201, "", "en", 1.0, "")]
    rows += [(202, "wört " * 40_000, "de", 0.0, "x"), (None, GOOD[0], "en", 0.0, "x"), rows[3], rows[3]]
    labels = [(i, int(i % 4 > 0)) for i in range(120)] + [(None, 1), (5, None), (6, 7), (0, 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int"), rows


def test_scores_are_the_densities(spark):
    docs, labels, rows = table(spark)
    learn = F.col("doc_id") % 3 > 0
    out = qc.quality_scores(docs, labels, learn, ["doc_id", "x", "score"], name="found")
    assert out.columns == ["doc_id", "x", "score", "found"]
    got = out.collect()
    assert len(got) == len(rows)

    x = qc.text_statistics([(r[1] or "").encode() for r in rows]) / qc.UNIT
    taught = [(k, int(r[0] % 4 > 0)) for k, r in enumerate(rows) if r[0] is not None and r[0] < 120 and r[0] % 3]
    y = np.array([c for _, c in taught])
    rows_of = x[[k for k, _ in taught]]
    own = [np.cov(rows_of[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * own[c] for c in (0, 1))
    odds = []
    for c in (0, 1):
        s = 0.9 * own[c] + 0.1 * pooled
        s = 0.95 * s + 0.05 * np.diag(np.maximum(np.diag(pooled), 1e-4))
        d = x - rows_of[y == c].mean(0)
        odds.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (d * np.linalg.solve(s, d.T).T).sum(1))
    want = {}
    for r, o in zip(rows, odds[1] - odds[0], strict=True):
        want.setdefault(r[0], 1 / (1 + math.exp(-math.asinh(o))))
    assert all(r.found == pytest.approx(want[r.doc_id], rel=1e-6) and 0 <= r.found <= 1 for r in got)
    unseen = [(r.found >= 0.3) == (r.doc_id % 4 > 0) for r in got if r.doc_id is not None and r.doc_id < 120 and r.doc_id % 3 == 0]
    assert len(unseen) > 35 and all(unseen)


def test_scores_do_not_depend_on_partitions(spark):
    docs, labels, _ = table(spark)
    learn = F.col("doc_id") % 2 == 0
    found = [sorted((str(r.doc_id), r.score) for r in qc.quality_scores(docs.repartition(n), labels, learn, ["doc_id"]).collect()) for n in (1, 7)]
    assert found[0] == found[1]


def test_moments_are_exact(spark):
    rows = [(i % 2, [i * 1000003, -i, 1 << 20]) for i in range(50)]
    got = qc.moments(spark.createDataFrame(rows, "label int, x array<bigint>").repartition(4))
    for c in (0, 1):
        own = [v for label, v in rows if label == c]
        assert got[c][0] == 25 and got[c][1] == [sum(v[i] for v in own) for i in range(3)]
        assert got[c][2] == [[sum(v[i] * v[j] for v in own) for j in range(3)] for i in range(3)]


def test_statistics():
    (row,) = qc.text_statistics(["Ab AB AB # |\n\nx, y. 12!\nx, y. 12!".encode()])
    values = dict(zip(qc.STATISTICS, row / qc.UNIT, strict=True))
    assert values["words"] == pytest.approx(math.log1p(11), abs=1e-4)
    assert values["repeated_words"] == pytest.approx(math.log1p(100 * 1 / 16), abs=1e-4)
    assert values["repeated_lines"] == pytest.approx(math.log1p(100 * 1 / 8), abs=1e-4)
    assert values["capitals"] == pytest.approx(math.log1p(100 * 5 / (36 - 1 + 5)), abs=0.1)
    assert not qc.text_statistics([b""]).any()


def test_without_both_classes(spark):
    docs, labels, rows = table(spark)
    for few in (labels.limit(0), labels.where("quality = 1")):
        assert {r.score for r in qc.quality_scores(docs, few, F.lit(True), ["doc_id"]).collect()} == {0.5}
    assert qc.quality_scores(docs.limit(0), labels, F.lit(True), ["doc_id"]).count() == 0
    same = qc.fit({0: (3, [5, 5], [[9, 9], [9, 9]]), 1: (1, [1, 1], [[1, 1], [1, 1]])})  # no spread at all
    assert np.isfinite(same.log_odds(np.array([[0.0, 1.0]]))).all()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_held_out_accuracy(spark):
    got = queries.op13_quality_classifier(spark, SF_DIR)
    held = got.where("held_out").join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id").collect()
    good, bad = ([r for r in held if r.quality == c] for c in (1, 0))
    assert len(good) > 50 and len(bad) > 8
    assert sum(r.predicted for r in good) >= 0.98 * len(good)
    assert sum(1 - r.predicted for r in bad) >= 0.95 * len(bad)
    above = sum(g.score > b.score for g in good for b in bad) / (len(good) * len(bad))
    assert above >= 0.99
