"""Kept sums against the full metric, after every batch."""

import random
from datetime import datetime, timedelta

from mergetide.operators.repos import distinct_repos
from mergetide.plans import metrics, rolling_state
from mergetide.sources import commits, compaction
from mergetide.sources.ingest import ingest_batch
from mergetide.sources.tables import Store, read_pulls
from tests.helpers import pr, rows
from tests.test_ingest import landed, page

RANGE = "2023-12-20", "2024-06-10"


def batch(rng, number):
    """Some 40 pull requests of two repositories, many known from before: merged, moved to another day, or not merged any more."""
    def text(moment):
        return moment.strftime("%Y-%m-%dT%H:%M:%SZ")

    items = {"a": [], "b": []}
    for _ in range(40):
        n = rng.randrange(60)
        created = datetime(2024, 1, 1) + timedelta(hours=37 * n, minutes=n % 7)
        merged = created + timedelta(days=rng.randrange(40), seconds=rng.randrange(5)) if rng.random() < 0.7 else None
        updated = datetime(2024, 9, 1) + timedelta(days=10 * number, minutes=rng.randrange(9000))
        name = "ab"[n % 2]
        moment = None if merged is None else text(merged)
        items[name].append(pr(n, text(created), updated=text(updated), closed=moment, merged=moment, name=name))
    return [page(f"r{number}", 1, *of, repo=name) for name, of in items.items()]


def full(spark, store):
    return rows(metrics.merged_duration_rolling(read_pulls(spark, store), *RANGE))


def kept(spark, store):
    repos = distinct_repos(read_pulls(spark, store))
    return rows(rolling_state.merged_duration_kept(rolling_state.read_points(spark, store), repos, *RANGE))


def test_equal_to_the_full_metric(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rolling_state, "FOLD_AFTER", 2)  # the third update folds those before it
    rng, store = random.Random(2), Store(str(tmp_path / "store"), buckets=2)
    assert not rolling_state.update_points(spark, store)
    for n in range(3):
        ingest_batch(landed(spark, *batch(rng, n)), store, n)
        if n == 1:
            compaction.merge_batches(spark, store)
        assert rolling_state.update_points(spark, store)
        assert kept(spark, store) == full(spark, store)
    assert not rolling_state.update_points(spark, store)
    assert len(commits.parts(spark, rolling_state._home(store)).live) == 1


def test_two_batches_at_once_and_two_updates_at_once(spark, tmp_path, monkeypatch):
    rng, store = random.Random(5), Store(str(tmp_path / "store"))
    for n in (0, 2):
        ingest_batch(landed(spark, *batch(rng, n)), store, n)
    seen = commits.parts(spark, rolling_state._home(store))
    assert rolling_state.update_points(spark, store)
    before = kept(spark, store)
    assert before == full(spark, store)
    look = commits.parts  # as one that looked before the other was done
    monkeypatch.setattr(commits, "parts", lambda spark, root: seen if root.endswith("rolling") else look(spark, root))
    assert not rolling_state.update_points(spark, store)
    monkeypatch.undo()
    assert kept(spark, store) == before
    ingest_batch(landed(spark, *batch(rng, 1)), store, 1)  # a number from before, committed late
    assert rolling_state.update_points(spark, store) and kept(spark, store) == full(spark, store)
