"""Connected components of links between long ids, as joins and grouped minima.

Each task first contracts the links it holds with union-find; the rest is done by
alternating large-star and small-star steps, which hang every node ever closer to the
least node of its component. Nothing but pairs of ids is moved, and a node with many
neighbours is a grouped minimum, never a collected list.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergetide.llm.common import staged


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, find(x)) for x in list(parent)]
    rows = [r for r in rows if r[0] != r[1]]
    for i in range(0, len(rows), 50_000):
        u, v = zip(*rows[i : i + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, component): the least node reachable, for every node with a link to another."""
    pairs = links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    edges = staged(pairs.mapInArrow(_contract, "u long, v long").distinct())
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.unionAll(lowest.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
