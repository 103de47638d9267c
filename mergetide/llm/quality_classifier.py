"""A regularised quadratic discriminant over statistics of whole texts.

Every text becomes a short vector of transformed statistics: its size, how long its words
are, how much it repeats, and how many of its characters are symbols, bars, shouts, digits
or capitals. Each class is a normal density whose covariance is shrunk, first towards the
covariance both share, then towards its diagonal, so that a statistic which never varies
within a class still has a width. The score is the logistic of the difference of the two
log-densities, drawn together by an inverse hyperbolic sine: the order stays as it is, and
far-off texts are told apart instead of all ending at 0 or 1.

Statistics are kept as whole numbers, so the moments are exact sums and the model is the
same however the rows are dealt out. The driver sees moments only: a few hundred numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from mergetide.llm.common import staged

STATISTICS = (
    "words", "word_bytes", "distinct_words", "repeated_words", "repeated_lines", "lines",
    "capitals", "symbols", "bars", "shouts", "stops", "commas", "digits",
)
UNIT = 1 << 16  # a statistic is a whole number of these parts
TO_POOLED, TO_DIAGONAL = 0.1, 0.05
LEAST_VARIANCE = 1e-4
_SYMBOLS, _BARS = list(b"#*$%&"), list(b"|<>")


def text_statistics(texts: list[bytes]) -> np.ndarray:
    """A row of ``STATISTICS`` for each whole text, in parts of 1 / UNIT."""
    raw = np.zeros((len(texts), len(STATISTICS) + 1))
    for row, text in zip(raw, texts, strict=True):
        seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words = text.split()
        lines = [line for line in text.split(b"\n") if line.strip()]
        row[:] = (
            len(words), len(text), len(set(words)), sum(map(bytes.__eq__, words, words[1:])), len(lines) - len(set(lines)), len(lines),
            seen[65:91].sum(), seen[_SYMBOLS].sum(), seen[_BARS].sum(), seen[33], seen[46] + seen[63], seen[44], seen[48:58].sum(), 0,
        )
    words, size, distinct, repeats, copies, lines, capitals, symbols, bars, shouts, stops, commas, digits, _ = raw.T

    def percent(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.log1p(100 * part / (whole + 5))

    columns = [
        np.log1p(words), np.log1p(size / (words + 1)), np.log((distinct + 1) / (words + 1)), percent(repeats, words), percent(copies, lines),
        percent(lines, words), percent(capitals, size), percent(symbols, words), percent(bars, words), percent(shouts, words),
        percent(stops, words), percent(commas, words), percent(digits, size),
    ]
    return np.rint(np.stack(columns, 1) * UNIT).astype(np.int64)


def with_statistics(docs: DataFrame, keep: list[Column], text: str = "text", name: str = "x") -> DataFrame:
    """``keep`` and the statistics of each whole text as an array of longs; a null text is empty."""
    kept = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias(name))
    schema = kept.drop(name).schema.add(name, ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = text_statistics(batch.column(batch.num_columns - 1).to_pylist())
            flat = pa.array(rows.ravel(), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], batch.schema.names)

    return kept.mapInArrow(run, schema)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and the constant parts of both log-densities; None where a class has no texts."""

    means: list[np.ndarray]
    whiten: list[np.ndarray]
    constants: list[float]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, with the classes' shares."""
        sides = [
            c - 0.5 * np.square((x - mean) @ w.T).sum(axis=1) for mean, w, c in zip(self.means, self.whiten, self.constants, strict=True)
        ]
        return sides[1] - sides[0]


def moments(marked: DataFrame, label: str = "label", x: str = "x") -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """By class: how many texts, the sums of their statistics and of all products of two. Exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten().to_numpy().reshape(len(labels), -1)
            rows = np.concatenate((np.ones((len(flat), 1), np.int64), flat), axis=1)  # 1 first: count and sums are products too
            for c in np.unique(labels).tolist():
                own = rows[labels == c]
                for i in range(0, len(own), 1 << 16):  # products below 2^43, so a sum of 2^16 fits
                    part = own[i : i + (1 << 16)]
                    sums[c] = sums.get(c, 0) + (part.T @ part).astype(object)
        for c, total in sums.items():
            k = len(total)
            i, j = (a.ravel().tolist() for a in np.indices((k, k)))
            values = [str(v) for v in total.ravel()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * k * k, pa.int64()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values)], ["c", "i", "j", "v"]
            )

    parts = marked.select(F.col(label).cast("long"), x).mapInArrow(run, "c long, i int, j int, v string")
    found = parts.groupBy("c", "i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # 14 x 14 for each class
    out = {}
    for c in {r.c for r in found}:
        own = {(r.i, r.j): int(r.v) for r in found if r.c == c}
        k = 1 + max(i for i, _ in own)
        out[c] = (own[0, 0], [own[0, j] for j in range(1, k)], [[own[i, j] for j in range(1, k)] for i in range(1, k)])
    return out


def fit(by_class: dict[int, tuple], to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Discriminant | None:
    """The discriminant of classes 0 and 1 from their moments; None unless both have texts."""
    if not by_class.get(0) or not by_class.get(1):
        return None
    counts = [by_class[c][0] for c in (0, 1)]
    means, own = [], []
    for c, n in enumerate(counts):
        _, s, p = by_class[c]
        means.append(np.array([v / n for v in s]) / UNIT)
        # Whole numbers up to the division: no digits are lost between large squares.
        own.append(np.array([[(n * p[i][j] - s[i] * s[j]) / (n * n) for j in range(len(s))] for i in range(len(s))]) / UNIT**2)
    total = sum(counts)
    pooled = sum(n * s for n, s in zip(counts, own, strict=True)) / total
    wide = np.diag(np.maximum(np.diag(pooled), LEAST_VARIANCE))
    whiten, constants = [], []
    for n, s in zip(counts, own, strict=True):
        shrunk = (1 - to_diagonal) * ((1 - to_pooled) * s + to_pooled * pooled) + to_diagonal * wide
        factor = np.linalg.cholesky(shrunk)
        whiten.append(np.linalg.inv(factor))
        constants.append(float(np.log(n / total) - np.log(np.diag(factor)).sum()))
    return Discriminant(means, whiten, constants)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    keep: list[str],
    doc_id: str = "doc_id",
    text: str = "text",
    quality: str = "quality",
    name: str = "score",
) -> DataFrame:
    """``keep`` and ``name``: how likely the text is of label 1, from 0 to 1, for every row of ``docs``.

    The model is learnt from all labelled rows where ``learn``, an expression over
    ``doc_id``, holds; nothing but the text enters a score. A document labelled twice is
    good if any label says so; labels other than 0 and 1 and null labels are left out.
    Null texts are empty and scored as such; equal texts get equal scores; rows without an
    id are scored but teach nothing. With texts of one class only, or no labels, all scores
    are 0.5. An empty table gives no rows. Other columns are left alone, whatever their names.
    """
    taken = [F.col(c) for c in keep]
    named = [f"k{i}" for i in range(len(keep))]
    kept = [c.alias(n) for c, n in zip(taken, named, strict=True)]
    found = staged(with_statistics(docs, [F.col(doc_id).alias("id"), learn.alias("learn"), *kept], text))
    marks = labels.select(F.col(doc_id).alias("id"), F.col(quality).cast("long").alias("label")).where("label in (0, 1)")
    marks = marks.groupBy("id").agg(F.max("label").alias("label"))
    model = fit(moments(found.where("learn").select("id", "x").join(marks, "id").select("label", "x")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(batch.num_rows, -1) / UNIT
            odds = np.zeros(len(x)) if model is None else model.log_odds(x)
            score = 1 / (1 + np.exp(-np.arcsinh(odds)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*named, "s"])

    slim = found.select(*named, "x")
    scored = slim.mapInArrow(run, slim.drop("x").schema.add("s", "double"))
    return scored.select(*[F.col(n).alias(c) for n, c in zip(named, keep, strict=True)], F.col("s").alias(name))
