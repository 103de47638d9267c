"""Hard negatives against brute force, over blocks and groups of any size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mergetide.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, score string, g int"


def brute(rows, is_anchor, n_positives=5, n_negatives=10, low=30, high=90):
    rows = {i: (label, v) for i, label, v in sorted(rows, key=lambda r: (r[0], r[1], r[2]), reverse=True)}
    out = set()
    for a in filter(is_anchor, rows):
        scored = sorted((-sum(x * y for x, y in zip(rows[a][1], v)), i) for i, (_, v) in rows.items() if i != a)
        same = [(i, -s) for s, i in scored if rows[i][0] == rows[a][0]][:n_positives]
        for p, best in same:
            found = [(i, -s) for s, i in scored if rows[i][0] != rows[a][0] and low * best <= -100 * s <= high * best]
            out |= {(a, p, k + 1, i, best, s) for k, (i, s) in enumerate(found[:n_negatives])}
    return out


def whole(rows):
    usable = [r for r in rows if None not in (r[0], r[1], r[2]) and all(x is not None and math.isfinite(x) for x in r[2])]
    return [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v, *_ in usable]


def found(df):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert df.columns == columns
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(4)), rng.normal(0, 0.3, 8).tolist(), "x", 1) for i in range(1, 160)]
    hot = rng.normal(0, 0.3, 8).tolist()
    rows += [(i, i % 3, hot, "x", 1) for i in range(200, 260)]  # one vector over and over: ties
    rows += [(300 + i, 0, [0.0] * 8, None, None) for i in range(5)]
    rows += [(400, 1, [0.5, -0.25], "short", 2), (401, 1, [], "none", 2)]
    rows += [(None, 1, hot, "x", 1), (500, None, hot, "x", 1), (501, 1, None, "x", 1), (502, 1, [None, 1.0], "x", 1)]
    rows += [(503, 1, [float("nan")] * 8, "x", 1), (504, 1, [float("inf")] + hot[1:], "x", 1)]
    return rows + [rows[4], rows[4], (7, 3, hot, "other", 0)]  # repeated rows, and one id with two vectors


@pytest.mark.parametrize(("cells", "group"), [(1 << 18, 32), (8 * 7, 2), (8, 1)])
def test_against_brute_force(spark, table, cells, group):
    df = spark.createDataFrame(table, SCHEMA).repartition(3)
    vectors = hn.whole_vectors(df, F.col("label"))
    got = hn.hard_negatives(vectors, F.col("vec_id") % 10 == 0, block_cells=cells, group_blocks=group)
    want = brute(whole(table), lambda i: i % 10 == 0)
    assert len(want) > 300 and found(got) == want


def test_windows_and_large_numbers(spark):
    rows = [(0, 0, [3, -1])] + [(i, 0, [1, i]) for i in range(1, 4)] + [(10 + i, 1, [i, 2]) for i in range(9)]
    for factor in (1, 1 << 11, 1 << 25, 1 << 29):  # singles, doubles, whole numbers
        large = [(i, label, [x * factor for x in v]) for i, label, v in rows]
        df = spark.createDataFrame(large, "vec_id long, label long, v array<bigint>")
        got = hn.hard_negatives(df, F.col("vec_id") == 0, n_positives=2, n_negatives=3, low=-500, high=400)
        assert found(got) == brute(large, lambda i: i == 0, 2, 3, -500, 400) != set()


def test_nothing_to_find(spark, table):
    df = spark.createDataFrame(table, SCHEMA)
    vectors = hn.whole_vectors(df, F.col("label"))
    assert found(hn.hard_negatives(vectors.limit(0), F.lit(True))) == set()
    assert found(hn.hard_negatives(vectors, F.lit(False))) == set()
    assert found(hn.hard_negatives(vectors.where("label = 2"), F.lit(True))) == set()


def test_lists_stop_early():
    """Sorted access ends once nothing unseen can be worth more: most rows of a long block are never scored."""
    rng = np.random.default_rng(1)
    cells = rng.integers(-9, 10, (5000, 2))
    cells[::1000] = 100
    block = hn.Lists(np.arange(5000).astype("<i8").tobytes(), np.zeros(5000, "<i8").tobytes(), cells.astype("<i8").tobytes(), 2)
    scored, score = [], block.scored
    block.scored = lambda at, anchor: scored.append(len(at)) or score(at, anchor)
    window = hn.Windowed(None, None, None, 3)
    block.visit(-1, 0, np.array([2, 1]), [window], True)
    assert window.ids.tolist() == [0, 1000, 2000] and window.scores.tolist() == [300] * 3
    assert sum(scored) < 200
