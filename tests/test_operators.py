import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mergetide.functions.dates import DAY_US
from mergetide.operators import rolling
from mergetide.operators.asof import asof_join
from mergetide.operators.latest import latest_per_key
from mergetide.operators.repos import drop_repos, keep_repos
from mergetide.operators.rolling import rolling_avg_at, rolling_range_avg
from mergetide.operators.search import bm25, search
from tests.helpers import EPOCH, plan, rows, ts


# --- latest -------------------------------------------------------------------


def test_latest(spark):
    data = [
        ("a", ts("2024-01-01"), 1, "old"),
        ("a", ts("2024-01-02"), 2, "new"),
        ("b", None, 9, "undated"),
        ("b", ts("2024-01-01"), 1, "dated"),
        ("c", ts("2024-01-01"), 1, "first"),
        ("c", ts("2024-01-01"), 2, "tie"),
        (None, ts("2024-01-01"), 1, "no key"),
        (None, ts("2024-01-03"), 1, "no key, later"),
    ]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, id long, what string")
    once = latest_per_key(df, ["k"], ["t", "id"])
    assert sorted(r["what"] for r in once.collect()) == ["dated", "new", "no key, later", "tie"]
    # Delivered twice, and in another order: nothing changes.
    again = latest_per_key(df.unionByName(df).orderBy("id"), ["k"], ["t", "id"])
    assert rows(again) == rows(once)
    assert "WindowGroupLimit" in plan(once)  # reduced before the shuffle


# --- repositories ----------------------------------------------------------------


@pytest.mark.parametrize("as_table", [False, True])
@pytest.mark.parametrize("limit", [0, 1000])
def test_repo_lists(spark, monkeypatch, as_table, limit):
    monkeypatch.setattr("mergetide.operators.repos.IN_LIST_MAX", limit)
    df = spark.createDataFrame([("a",), ("b",), (None,), ("b",)], "repo string")

    def listed(*names):
        return spark.createDataFrame([(n,) for n in names], "repo string") if as_table else list(names)

    assert rows(keep_repos(df, listed("b", "b", "zz"))) == [("b",), ("b",)]
    assert rows(drop_repos(df, listed("b", "zz"))) == [("a",)]
    assert rows(drop_repos(df, listed("a", "b"))) == []
    assert rows(keep_repos(df, [])) == rows(keep_repos(df)) == [("a",), ("b",), ("b",)]
    assert rows(drop_repos(df, [])) == [("a",), ("b",), ("b",)]


# --- rolling averages --------------------------------------------------------------

ROWS = "id long, k string, t timestamp_ntz, v decimal(10,2)"


def brute_rolling(data, width):
    result = {}
    for i, k, t, _ in data:
        if t is None:
            frame = [v for _, k2, t2, v in data if k2 == k and t2 is None]
        else:
            low = t - timedelta(microseconds=width)
            frame = [v for _, k2, t2, v in data if k2 == k and t2 is not None and low <= t2 <= t]
        frame = [v for v in frame if v is not None]
        result[i] = float(sum(frame)) / len(frame) if frame else None
    return result


def same(found, expected):
    assert found.keys() == expected.keys()
    for i, value in expected.items():
        assert (found[i] is None) == (value is None)
        assert value is None or math.isclose(found[i], value, rel_tol=1e-12)


@pytest.mark.parametrize(
    "unit,width", [(1, 60), (1, 30 * 36), (1_000_000, 30 * DAY_US), (977, 97_000), (1, 61), (1, 26), (1, 13), (977, 999_983)]
)
@pytest.mark.parametrize("bound", [10, 10**12])
def test_rolling_methods_agree(spark, monkeypatch, unit, width, bound):
    """One level of buckets, two levels, the plain window and brute force."""
    from decimal import Decimal

    monkeypatch.setattr(rolling, "INSTANTS_PER_TASK", bound)
    rng = random.Random(width)
    span = 5 * width // unit
    data = []
    for i in range(250):
        k = rng.choice(["hot", "hot", "hot", "x", None])
        t = EPOCH + timedelta(microseconds=(rng.randrange(span) - span // 3) * unit) if rng.random() < 0.95 else None
        v = Decimal(rng.randrange(10_000)) / 100 if rng.random() < 0.9 else None
        data.append((i, k, t, v))
    df = spark.createDataFrame(data, ROWS)
    expected = brute_rolling(data, width)
    for method in ("plain", "bucketed"):
        found = rolling_range_avg(df, ["k"], "t", "v", width, "m", method=method)
        same({r["id"]: r["m"] for r in found.collect()}, expected)
        assert found.columns == ["id", "k", "t", "v", "m"]


@pytest.mark.parametrize("method", ["plain", "bucketed"])
def test_rolling_edges(spark, method):
    t0 = datetime(2024, 1, 1)
    day30 = t0 + timedelta(days=30)
    data = [
        (1, "in", t0, 10.0), (2, "in", day30, 20.0),
        (3, "out", t0, 10.0), (4, "out", day30 + timedelta(microseconds=1), 20.0),
        (5, "peers", t0, 1.0), (6, "peers", t0, 3.0),
    ]
    df = spark.createDataFrame(data, "id long, k string, t timestamp_ntz, v double")
    found = rolling_range_avg(df, ["k"], "t", "v", 30 * DAY_US, "m", method=method)
    assert {r["id"]: r["m"] for r in found.collect()} == {1: 10, 2: 15, 3: 10, 4: 20, 5: 2, 6: 2}


def test_rolling_at_probes(spark):
    facts = spark.createDataFrame([("k", 5, 1.0), ("k", 7, 3.0)], "k string, t long, v double")
    probes = spark.createDataFrame([("k", 4, "a"), ("k", 6, "b"), ("k", 8, "c"), ("z", 6, "d")], "k string, t long, p string")
    found = rolling_avg_at(facts, probes, ["k"], "t", "v", 2, "m")
    assert {r["p"]: r["m"] for r in found.collect()} == {"a": None, "b": 1.0, "c": 3.0, "d": None}


@pytest.mark.parametrize("bound", [10, 10**12])
def test_rolling_at_other_times(spark, monkeypatch, bound):
    """Probes are no facts: they lie anywhere, between slices without facts too."""
    monkeypatch.setattr(rolling, "INSTANTS_PER_TASK", bound)
    rng = random.Random(3)
    width = 240
    facts = [(rng.choice("ab"), rng.randrange(-2000, 2000), float(rng.randrange(100))) for _ in range(120)]
    asked = [(rng.choice("abc"), rng.randrange(-2300, 2300), i) for i in range(150)]
    fdf = spark.createDataFrame(facts, "k string, t long, v double")
    pdf = spark.createDataFrame(asked, "k string, t long, p long")
    found = {r["p"]: r["m"] for r in rolling_avg_at(fdf, pdf, ["k"], "t", "v", width, "m").collect()}
    expected = {}
    for k, t, p in asked:
        frame = [v for k2, t2, v in facts if k2 == k and t - width <= t2 <= t]
        expected[p] = sum(frame) / len(frame) if frame else None
    same(found, expected)


def test_rolling_never_slides_over_rows(spark):
    """Running sums only: a sliding frame costs rows times frame length."""
    df = spark.createDataFrame([(1, "k", ts("2024-01-01"), 1.0)], "id long, k string, t timestamp_ntz, v double")
    text = plan(rolling_range_avg(df, ["k"], "t", "v", 30 * DAY_US, "m"))
    assert "RangeFrame, unboundedpreceding" in text
    assert f"-{30 * DAY_US}" not in text


# --- as-of joins -----------------------------------------------------------------


def brute_asof(left, right, direction, exact, tolerance):
    result = {}
    for i, k, t in left:
        best = None
        for j, k2, t2 in right:
            if None in (k, t, k2, t2) or k2 != k:
                continue
            gap = (t - t2 if direction == "backward" else t2 - t) / timedelta(microseconds=1)
            if gap < 0 or (gap == 0 and not exact):
                continue
            if best is None or (gap, -j) < best:
                best = (gap, -j)
        result[i] = None if best is None or (tolerance is not None and best[0] > tolerance) else -best[1]
    return result


@pytest.mark.parametrize("buckets", [None, "measured", (1_000_000, 86_400), (86_400_000_000,), (1_200_000_000, 7, 11)])
@pytest.mark.parametrize("direction,exact", [("backward", True), ("backward", False), ("forward", True), ("forward", False)])
def test_asof_against_brute_force(spark, buckets, direction, exact):
    tolerance = None if buckets in (None, (86_400_000_000,)) else 3_600_000_000
    options = {"method": "window"} if buckets is None else {"method": "bucketed", "buckets": buckets}
    if buckets == "measured":
        options = {"hot_rows": 60}
    options |= {"direction": direction, "allow_exact": exact, "tolerance": tolerance}
    rng = random.Random(11)

    def make(count):
        rows = []
        for i in range(count):
            k = rng.choice(["a", "a", "a", "b", "lonely", None])
            t = EPOCH + timedelta(minutes=rng.randrange(-600, 5000, 10)) if rng.random() < 0.95 else None
            rows.append((i, k, t))
        return rows

    left, right = make(150), make(80)
    ldf = spark.createDataFrame(left, "i long, k string, t timestamp_ntz")
    rdf = spark.createDataFrame(right, "j long, k string, u timestamp_ntz")
    found = asof_join(ldf, rdf, ["k"], "t", "u", ["j"], ["j"], **options)
    assert found.columns == ["i", "k", "t", "j"]
    expected = brute_asof(left, right, direction, exact, tolerance)
    assert {r["i"]: r["j"] for r in found.collect()} == expected
    if exact:
        inner = asof_join(ldf, rdf, ["k"], "t", "u", ["j"], ["j"], how="inner", **options)
        assert {r["i"]: r["j"] for r in inner.collect()} == {i: j for i, j in expected.items() if j is not None}
    text = plan(found)
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("method", ["window", "bucketed", "measured"])
def test_asof_keeps_null_payload_and_repeated_left_rows(spark, method):
    left = spark.createDataFrame([(1, "k", 10), (2, "k", 10), (3, "k", 10), (3, "k", 10)], "i long, k string, t long")
    right = spark.createDataFrame([("k", 5, "old"), ("k", 9, None)], "k string, u long, p string")
    found = asof_join(left, right, ["k"], "t", "u", ["p", "u"], method=method, buckets=(4,), hot_rows=2)
    assert rows(found) == [(1, "k", 10, None, 9), (2, "k", 10, None, 9), (3, "k", 10, None, 9), (3, "k", 10, None, 9)]


# --- search ---------------------------------------------------------------------


def brute_bm25(docs, query):
    import regex

    texts = {i: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w] for i, t in docs}
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    scores = {}
    for i, words in texts.items():
        counts = Counter(words)
        for term in dict.fromkeys(w for w in regex.split(r"[^\p{L}\p{N}]+", query.lower()) if w):
            if counts[term]:
                df = sum(term in w for w in texts.values())
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                tf = counts[term]
                scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
    return scores


@pytest.mark.parametrize("staged", [False, True])
def test_bm25(spark, tmp_path, staged):
    docs = [
        (1, "The quick brown fox"), (2, "quick quick, QUICK!"), (3, ""), (4, None),
        (5, "Müßig im Garten; die Füchse 2x2"), (6, "fox " * 500 + "end"), (7, "nothing here"),
    ]
    df = spark.createDataFrame(docs, "id long, body string")
    stage = str(tmp_path / "counts") if staged else None
    for query in ("quick fox", "MÜSSIG müßig 2x2", "fox fox"):
        found = {r["id"]: r["score"] for r in bm25(df, "id", "body", query, stage).collect()}
        expected = brute_bm25(docs, query)
        assert found.keys() == expected.keys()
        assert all(math.isclose(found[i], expected[i], rel_tol=1e-12) for i in expected)
    assert [r["id"] for r in search(df, "id", "body", "quick", k=1, stage=stage).collect()] == [2]
    assert bm25(df, "id", "body", " ,;").collect() == []
    text = plan(bm25(df, "id", "body", "quick fox"))
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text
