"""Hard negatives of anchor vectors by Fagin's threshold algorithm.

Candidates lie in blocks, and a block keeps a list of its rows for every dimension, sorted
by that component. An anchor reads the lists from the end its own component's sign
prefers, so that what it has not met yet is worth at most the threshold: the sum of its
products with the last component read from each list. Rows it meets are scored by random
access to their whole vectors, in exact integers. A window of scores is settled by a block
once the threshold lies strictly below its last place, or below the window itself.

Candidate groups stay where they are; anchors, a small share of the rows, travel to each
group as plain rows and pass by its blocks one after another. No score of a pair that is
not among the first few of a group leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergetide.llm.common import staged

BLOCK_CELLS = 1 << 18  # components in a block
GROUP_BLOCKS = 32  # blocks that meet the anchors in one task
FIRST_STEP = 32  # sorted accesses to each list before the threshold is looked at; then twice as many, and so on

_BLOCK = "g long, kind int, part long, vec_id long, label long, v array<bigint>, p_ids array<bigint>, p_scores array<bigint>, ids binary, labels binary, cells binary, dims int"
_FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def whole_vectors(
    rows: DataFrame, label: Column, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(vec_id, label, v): components as floor(scale * x); rows that cannot take part are left out.

    Those are rows without id, label or vector, or with a component that is null or not finite.
    """
    x = F.col("_v")
    usable = rows.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).alias("_v")).where(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.coalesce(F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))), F.lit(False))
    )
    return usable.select("vec_id", "label", F.transform(x, lambda c: F.floor(scale * c.cast("double")).cast("long")).alias("v"))


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 10,
    low: int = 30,
    high: int = 90,
    block_cells: int = BLOCK_CELLS,
    group_blocks: int = GROUP_BLOCKS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all pairs in full.

    ``vectors`` has vec_id, label and the whole-number vector ``v`` (see ``whole_vectors``);
    ``is_anchor`` says of its columns which rows are anchors. A score is the inner product;
    higher ones come first, ties by smaller vec_id. Positives are an anchor's first
    ``n_positives`` other rows of its label; of the rows of other labels with
    low * positive <= 100 * score <= high * positive the first ``n_negatives`` are returned.

    Of rows with one vec_id the least (label, v) counts. A shorter vector counts as ending
    in zeros. Anchors without positives, and windows without rows, give no rows; an empty
    table gives none. Other columns are ignored. A score beyond 64 bits is an error.
    """
    spark = vectors.sparkSession
    one = F.min(F.struct(F.col("label").cast("long").alias("label"), F.col("v").cast("array<bigint>").alias("v"))).alias("row")
    named = vectors.where("vec_id is not null and label is not null and v is not null")
    rows = staged(named.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(one).select("vec_id", "row.label", "row.v"))
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    block = max(1, min(1 << 16, block_cells // max(1, dims)))
    blocks = -(-n // block)
    groups = max(1, -(-blocks // group_blocks), min(blocks, 2 * spark.sparkContext.defaultParallelism))
    candidates = staged(rows.repartition(groups, "vec_id").mapInArrow(_blocks(block), _BLOCK))
    last = candidates.agg(F.coalesce(F.max("g"), F.lit(-1))).first()[0]
    if last < 0:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    anchors = rows.where(is_anchor)
    kept = _first(_search(candidates, anchors, last, n_positives, 0, 0), ["anchor_id"], n_positives)
    one_each = kept.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("p"))  # n_positives at most
    windows = anchors.join(one_each, F.col("vec_id") == F.col("anchor_id")).select(
        "vec_id", "label", "v", F.col("p.vec_id").alias("p_ids"), F.col("p.score").alias("p_scores")
    )
    found = _search(candidates, staged(windows), last, n_negatives, low, high)
    ranked = _first(found, ["anchor_id", "positive_id", "positive_score"], n_negatives)
    return ranked.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _first(found: DataFrame, key: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _blocks(size: int):
    """Rows to blocks: ids, labels, and cells row by row as 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, part = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= size:
                table = pa.Table.from_batches(held)
                while table.num_rows >= size:
                    yield _block(table.slice(0, size), group, part)
                    table, part = table.slice(size), part + 1
                held = table.to_batches()
        table = pa.Table.from_batches(held) if held else None
        if table is not None and table.num_rows:
            yield _block(table, group, part)

    return run


def _block(table: pa.Table, group: int, part: int) -> pa.RecordBatch:
    cells = _matrix(table.column(2).combine_chunks(), 0)
    return pa.RecordBatch.from_pylist(
        [
            {
                "g": group, "kind": 0, "part": part, "vec_id": None, "label": None, "v": None, "p_ids": None, "p_scores": None,
                "ids": table.column(0).to_numpy().astype("<i8").tobytes(), "labels": table.column(1).to_numpy().astype("<i8").tobytes(),
                "cells": cells.astype("<i8").tobytes(), "dims": cells.shape[1],
            }
        ],
        schema=_SCHEMA,
    )


_LONGS = pa.list_(pa.int64())
_SCHEMA = pa.schema(
    [("g", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("v", _LONGS)]
    + [("p_ids", _LONGS), ("p_scores", _LONGS), ("ids", pa.binary()), ("labels", pa.binary()), ("cells", pa.binary()), ("dims", pa.int32())]
)


def _matrix(vectors: pa.Array, least: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix, zeros at the end of shorter ones."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), max([least, *sizes.tolist()])), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy()
    return out


def _search(candidates: DataFrame, anchors: DataFrame, last: int, most: int, low: int, high: int) -> DataFrame:
    """The first rows of each group for each anchor (and window). Without p_ids those of the anchor's own label are meant."""
    nothing = F.lit(None).cast("array<bigint>")
    ids, scores = (F.col(c) if c in anchors.columns else nothing for c in ("p_ids", "p_scores"))
    everywhere = anchors.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("g"), F.lit(1).alias("kind"), F.col("vec_id").alias("part"),
        "vec_id", "label", "v", ids.alias("p_ids"), scores.alias("p_scores"),
    )
    met = candidates.unionByName(everywhere, allowMissingColumns=True).repartitionById(last + 1, F.col("g").cast("int"))
    met = met.sortWithinPartitions("g", "kind", "part")
    return met.mapInArrow(_meet(most, low, high), _FOUND)


def _meet(most: int, low: int, high: int):
    names = ["anchor_id", "positive_id", "positive_score", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                if r["g"] != group:
                    group, held = r["g"], []
                if r["kind"] == 0:
                    held.append(Lists(r["ids"], r["labels"], r["cells"], r["dims"]))
                    continue
                if r["p_ids"] is None:
                    windows = [Windowed(None, None, None, most)]
                else:
                    windows = [Windowed(s, low, high, most) for s in r["p_scores"]]
                for lists in held:
                    lists.visit(r["vec_id"], r["label"], np.array(r["v"], np.int64), windows, r["p_ids"] is None)
                for p, w in zip(r["p_ids"] or [None], windows, strict=True):
                    rows += [(r["vec_id"], p, w.positive, i, s) for i, s in zip(w.ids.tolist(), w.scores.tolist(), strict=True)]
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


class Windowed:
    """The first ``most`` rows met with low * positive <= 100 * score <= high * positive; without a positive, of all."""

    def __init__(self, positive: int | None, low: int | None, high: int | None, most: int):
        self.positive, self.most = positive, most
        self.low = self.high = None
        if positive is not None:
            self.low, self.high = -(-low * positive // 100), high * positive // 100  # whole scores between them
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        inside = np.ones(len(ids), bool)
        if self.positive is not None:
            inside = (scores >= self.low) & (scores <= self.high)
        if len(self.ids) == self.most:
            inside &= scores >= self.scores[-1]
        if inside.any():
            ids, scores = np.concatenate((self.ids, ids[inside])), np.concatenate((self.scores, scores[inside]))
            order = np.lexsort((ids, -scores))[: self.most]
            self.ids, self.scores = ids[order], scores[order]

    def settled(self, threshold: int) -> bool:
        """No row worth ``threshold`` at most can change it."""
        if self.low is not None and (self.low > self.high or threshold < self.low):
            return True
        return len(self.ids) == self.most and threshold < self.scores[-1]


class Lists:
    """A block of rows with a list of them for every dimension, sorted by that component."""

    def __init__(self, ids: bytes, labels: bytes, cells: bytes, dims: int):
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.cells = np.frombuffer(cells, "<i8").reshape(len(self.ids), dims)
        self.most = max((abs(int(x)) for x in (self.cells.min(), self.cells.max())), default=0) if self.cells.size else 0
        self.order = np.ascontiguousarray(np.argsort(self.cells, axis=0, kind="stable").T.astype(np.uint16))
        self.values = np.ascontiguousarray(np.take_along_axis(self.cells.T, self.order.astype(np.int64), axis=1))
        self.forms: dict[str, np.ndarray] = {}

    def scored(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products, by floating point only where no sum can lose a digit."""
        bound = sum(abs(int(x)) for x in anchor) * self.most
        kind = "f4" if bound < 1 << 24 else "f8" if bound < 1 << 53 else "O"
        if kind not in self.forms:
            self.forms[kind] = self.cells.astype(kind)
        return (self.forms[kind][at] @ anchor.astype(kind)).astype(np.int64)

    def visit(self, anchor_id: int, label: int, anchor: np.ndarray, windows: list[Windowed], same: bool) -> None:
        """Adds to the windows what this block has for them, by sorted and random access."""
        n, dims = self.cells.shape
        anchor = np.concatenate((anchor[:dims], np.zeros(max(0, dims - len(anchor)), np.int64)))
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        wanted = (self.labels == label) if same else (self.labels != label)
        wanted &= self.ids != anchor_id
        seen = np.zeros(n, bool)
        depth, step = 0, FIRST_STEP
        while depth < n:
            if len(up) + len(down) == 0:  # every row is worth nothing: no list to read
                begin, end, met = 0, n, np.ones(n, bool)
            else:
                begin, end = depth, min(n, depth + step)
                met = np.zeros(n, bool)
                met[self.order[up, n - end : n - begin]] = True
                met[self.order[down, begin:end]] = True
            new = np.flatnonzero(met & ~seen & wanted)
            seen |= met
            if len(new):
                scores = self.scored(new, anchor)
                for w in windows:
                    w.add(self.ids[new], scores)
            depth, step = end, 2 * step
            if depth < n:
                ends = np.concatenate((self.values[up, n - depth], self.values[down, depth - 1])).tolist()
                threshold = sum(int(a) * x for a, x in zip(np.concatenate((anchor[up], anchor[down])).tolist(), ends, strict=True))
                if all(w.settled(threshold) for w in windows):
                    return
