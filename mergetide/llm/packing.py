"""Lexical retrieval packing: documents that share rare words fill a window together.

Every document is encoded once. Full windows are cut off its front; what is left of it,
its tail, is a unit of packing. Tails are laid out by their weightiest term, so that
alike ones meet in one shard, and a shard holds a bounded number of ids. Within a shard
an inverted index of BM25 weights is kept: each seed asks it for its nearest unused
neighbours, which fill the seed's window in order of score. A neighbour that does not
fit is cut, and its rest is the next seed. The terms are the tokenizer's ids, so the
document frequencies, counted over all documents, are a vector as long as the vocabulary
whatever the size of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergetide.llm.common import staged
from mergetide.llm.token_counts import by_bytes
from mergetide.llm.tokens import encoder, vocabulary_size

WINDOW = 2048
SHARD_IDS = 1 << 20
K1, B = 1.2, 0.75
KNOWN = 600_000  # pieces of text each worker remembers the ids of
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
DIGESTS = PIECES.replace("ids binary", "ids_crc32 long")
_WHOLE = 1 << 62  # sequences cut from one document alone are numbered from here


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    window: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
    shard_ids: int = SHARD_IDS,
    digest: bool = False,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids (a power of two).

    ``start`` is the piece's place in its document, ``offset`` its place in its sequence,
    ``ids`` its ids as little-endian unsigned 32-bit integers; with ``digest`` the task that
    packs them returns their unsigned crc32 instead, ``ids_crc32``. Each id, ``end_id`` after
    each document too, lies in one piece. What a shard has left for its last sequence is
    laid into sequences of powers of two, which need no padding either. Of tails with equal
    scores the one laid out first is taken. A null text is empty (``end_id`` alone); equal
    rows are packed one by one; an empty table gives none. Other columns are ignored.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    wide = vocabulary_size(tokenizer) > 1 << 16 or end_id >= 1 << 16
    kind, schema = "<u4" if wide else "<u2", DIGESTS if digest else PIECES
    named = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    encoded = staged(_encode(named, tokenizer, end_id, kind, window))
    counts = _counts(encoded, kind, window)
    if not counts:
        return docs.sparkSession.createDataFrame([], schema)
    size = 1 + max(counts)
    frequency = np.zeros(max(size, 1), np.int64)
    for term, n in counts.items():
        if term >= 0:
            frequency[term] = n
    n_docs, n_tails, n_tail_ids = counts[-1], counts[-2], counts[-3]
    idf = np.log(1 + (n_docs - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    mean = n_tail_ids / max(1, n_tails)

    full = encoded.where(F.col("n") >= window).select("doc_id", "ids").mapInArrow(_full_windows(kind, window, digest), schema)
    cut = (F.col("n") % window).cast("int") * np.dtype(kind).itemsize
    tail = F.expr("substring(ids, cast(octet_length(ids) as int) - cut + 1, cut)")
    tails = (
        encoded.where(F.col("n") % window > 0)
        .select("doc_id", (F.col("n") - F.col("n") % window).alias("start"), "n", cut.alias("cut"), "ids", "terms", "times")
        .select("doc_id", "start", "n", tail.alias("ids"), "terms", "times")
    )
    weighed = tails.mapInArrow(_weighed(kind, idf), "term int, doc_id long, start long, n long, ids binary, terms binary, times binary")
    # Written before they are laid out: Spark samples the columns of the order, and reads no others for that.
    weighed = staged(weighed.withColumn("h", F.xxhash64("ids")))
    shards = max(1, -(-n_tail_ids // shard_ids))
    order = ["term", "doc_id", "start", "h"]
    laid = weighed.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    laid = laid.select("doc_id", "start", "n", "ids", "terms", "times")
    return full.unionAll(laid.mapInArrow(_fill(kind, window, idf, mean, shard_ids, digest), schema))


def _encode(docs: DataFrame, tokenizer: str, end_id: int, kind: str, window: int) -> DataFrame:
    """(doc_id, n, ids, terms, times): the ids of each text, and the distinct ones of its tail with how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([end_id], kind)
        for batch in batches:
            for part in by_bytes(batch, 1):
                ids, starts = encoder(tokenizer, KNOWN).encode(part.column(1))
                ids = ids.astype(kind)
                sizes, rows, terms, times = [], [], [], []
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    row = np.concatenate((ids[a:b], last))
                    term, time = np.unique(row[len(row) // window * window :], return_counts=True)
                    sizes.append(len(row))
                    rows.append(row.tobytes())
                    terms.append(term.tobytes())
                    times.append(time.astype("<u4").tobytes())
                columns = [part.column(0), pa.array(sizes, pa.int64()), *[pa.array(c, pa.binary()) for c in (rows, terms, times)]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "ids", "terms", "times"])

    return docs.mapInArrow(run, "doc_id long, n long, ids binary, terms binary, times binary")


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    """All values of a binary column one after another, as numbers."""
    offsets = np.frombuffer(column.buffers()[1], "<i4", len(column) + 1, 4 * column.offset)
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, kind, int(offsets[-1] - offsets[0]) // size, int(offsets[0]))


def _counts(encoded: DataFrame, kind: str, window: int) -> dict[int, int]:
    """Documents by term; under -1 all documents, -2 tails, -3 ids in tails. As long as the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, np.int64)
        n_docs = n_tails = n_ids = 0
        for batch in batches:
            n = batch.column(0).to_numpy()
            longer = [np.unique(np.frombuffer(v.as_py(), kind)) for v in batch.column(2).drop_null()]
            for terms in (_flat(batch.column(1), kind), *longer):
                found = np.bincount(terms, minlength=len(seen))
                seen = found + np.pad(seen, (0, len(found) - len(seen)))
            n_docs += len(n)
            n_tails += int((n % window > 0).sum())
            n_ids += int((n % window).sum())
        at = np.flatnonzero(seen)
        terms, values = [*at.tolist(), -1, -2, -3], [*seen[at].tolist(), n_docs, n_tails, n_ids]
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(values, pa.int64())], ["term", "n"])

    # The tail of a short text is all of it; a longer one is gone through again.
    short = F.when(F.col("n") < window, F.col("terms")).otherwise(F.lit(b""))
    needed = encoded.select("n", short.alias("terms"), F.when(F.col("n") >= window, F.col("ids")).alias("ids"))
    counted = needed.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in counted.collect()}


def _full_windows(kind: str, window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, rows = _WHOLE | TaskContext.get().partitionId() << 32, []
        for batch in batches:
            for doc_id, value in zip(batch.column(0), batch.column(1), strict=True):
                ids, name = np.frombuffer(value.as_py(), kind), doc_id.as_py()
                for start in range(0, len(ids) - window + 1, window):
                    rows.append((name, start, window, ids[start : start + window], len(ids), sequence, 0))
                    sequence += 1
                    if len(rows) == 512:
                        yield _batch(rows, digest)
                        rows = []
        if rows:
            yield _batch(rows, digest)

    return run


def _weighed(kind: str, idf: np.ndarray):
    """Puts each tail's weightiest term before it."""
    names = ["term", "doc_id", "start", "n", "ids", "terms", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, times = _flat(batch.column(4), kind), _flat(batch.column(5), "<u4").astype(np.int64)
            sizes = pc.binary_length(batch.column(4)).to_numpy() // np.dtype(kind).itemsize
            if not len(sizes):
                continue
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            weights = idf[terms] * (times / (times + K1))
            best = np.flatnonzero(weights == np.repeat(np.maximum.reduceat(weights, starts), sizes))
            first = terms[best[np.searchsorted(best, starts)]]
            yield pa.RecordBatch.from_arrays([pa.array(first.astype(np.int32)), *batch.columns], names)

    return run


def _fill(kind: str, window: int, idf: np.ndarray, mean: float, shard_ids: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, rows, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc_id, start, n, *values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids, terms, times = (np.frombuffer(v, k) for v, k in zip(values, (kind, kind, "<u4"), strict=True))
                rows.append((doc_id, start, n, ids, terms, times))
                held += len(ids)
                if held >= shard_ids:
                    pieces, sequence = fill_shard(rows, sequence, window, idf, mean)
                    yield from (_batch(pieces[i : i + 2048], digest) for i in range(0, len(pieces), 2048))
                    rows, held = [], 0
        if rows:
            pieces, sequence = fill_shard(rows, sequence, window, idf, mean)
            yield from (_batch(pieces[i : i + 2048], digest) for i in range(0, len(pieces), 2048))

    return run


class Index:
    """BM25 weights by term of the unused tails of a shard.

    Terms that stand in an eighth of the tails or more hold a weight for every tail, which
    is added up faster than it is looked up, and takes eight times the postings at most.
    """

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray], docs: np.ndarray):
        self.docs = docs
        owner = np.repeat(np.arange(len(docs)), [len(terms[d]) for d in docs])
        term = np.concatenate([terms[d] for d in docs])
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = owner[order], np.concatenate([weights[d] for d in docs])[order].astype(np.float64)
        self.terms, begins, sizes = np.unique(term[order], return_index=True, return_counts=True)
        self.begins = np.append(begins, len(term))
        common = 8 * sizes >= len(docs)
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        place = np.flatnonzero(np.repeat(common, sizes))
        self.rows = np.zeros((np.count_nonzero(common), len(docs)), np.float32)
        self.rows[np.repeat(self.row[common], sizes[common]), self.owner[place]] = self.weight[place]

    def scores(self, query: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, query), len(self.terms) - 1)
        at = at[self.terms[at] == query]
        row = self.row[at]
        common = self.rows[row[row >= 0]].sum(axis=0)
        at = at[row < 0]
        begins, sizes = self.begins[at], self.begins[at + 1] - self.begins[at]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)
        return common + np.bincount(self.owner[place], self.weight[place], len(self.docs))


def fill_shard(rows: list[tuple], sequence: int, window: int, idf: np.ndarray, mean: float) -> tuple[list[tuple], int]:
    """The pieces of a shard's tails (doc_id, start, doc_tokens, ids, terms, times) in sequences numbered from ``sequence``."""
    terms, weights = [r[4] for r in rows], []
    for _, _, _, ids, term, times in rows:
        times = times.astype(np.int64)
        weights.append(idf[term] * (times * (K1 + 1) / (times + K1 * (1 - B + B * len(ids) / mean))))
    unused = np.ones(len(rows), bool)
    left = sum(len(r[3]) for r in rows)
    index = Index(terms, weights, np.arange(len(rows)))
    pieces: list[tuple] = []
    rest: tuple[int, int] | None = None  # a tail that was cut, and where its rest begins
    next_unused, n_unused = 0, len(rows)

    while left:
        room, offset = min(window, 1 << (left.bit_length() - 1)), 0
        left -= room
        neighbours: Iterator[int] = iter(())
        asked = False
        while room:
            if rest is None:
                if asked:
                    doc = next(neighbours, -1)
                    while doc >= 0 and not unused[doc]:
                        doc = next(neighbours, -1)
                else:
                    doc = -1
                if doc < 0:  # the first of a window, or nothing alike is left
                    while not unused[next_unused]:
                        next_unused += 1
                    doc = next_unused
                rest = (doc, 0)
                unused[doc] = False
                n_unused -= 1
            doc, begin = rest
            name, start, total, ids = rows[doc][:4]
            length = min(room, len(ids) - begin)
            pieces.append((name, start + begin, length, ids[begin : begin + length], total, sequence, offset))
            offset += length
            room -= length
            rest = (doc, begin + length) if begin + length < len(ids) else None
            if room and not asked:
                asked = True
                if n_unused and 2 * n_unused < len(index.docs):
                    index = Index(terms, weights, np.flatnonzero(unused))
                if n_unused:
                    score = index.scores(terms[doc])
                    score[~unused[index.docs]] = 0
                    neighbours = _best_first(index.docs, score)
        sequence += 1
    return pieces, sequence


def _best_first(docs: np.ndarray, score: np.ndarray, first: int = 64) -> Iterator[int]:
    """Documents by score, equal ones as they lie; none without any. A window seldom needs more than the ``first``."""
    alike = np.flatnonzero(score)
    found = score[alike]
    if len(alike) > first:
        best = found >= np.partition(found, -first)[-first]
        for part in (best, ~best):
            yield from docs[alike[part][np.argsort(-found[part], kind="stable")]].tolist()
    else:
        yield from docs[alike[np.argsort(-found, kind="stable")]].tolist()


def _batch(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) as they are returned."""
    columns = [list(c) for c in zip(*rows, strict=True)]
    packed = (ids.astype("<u4").tobytes() for ids in columns[3])
    columns[3] = pa.array([zlib.crc32(p) for p in packed], pa.int64()) if digest else pa.array(packed, pa.binary())
    names = [c.split()[0] for c in (DIGESTS if digest else PIECES).split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)
