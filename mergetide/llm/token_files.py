"""Token ids in binary files: patched frame-of-reference blocks.

A file holds the ids of documents one after another, in blocks of ``BLOCK`` ids (the
last may be shorter). A block keeps its minimum, a width that fits the chosen percentile
of the differences, the differences' low bits packed at that width, and an exception
list (place, high bits) for those that do not fit. The footer has the byte offset of
every block and the id and length of every document, so any range of ids is found
by one seek.

    "PFOR0001" | blocks | offsets u64[blocks+1] | doc ids i64[docs] | id is set u8[docs] |
    lengths u64[docs] | counts u64[3]: blocks, docs, ids | "PFOR0001"
    block: ids u16, width u8, u8 0, minimum u32, exceptions u16, u16 0 | packed | places u16[] | high bits u32[]

Tasks write files under unique names and return them; only files named in the manifest,
which Spark commits, are part of the data, so a lost executor or a repeated task leaves
at most a file nobody reads.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergetide.llm.common import file_system, staged
from mergetide.llm.token_counts import by_bytes
from mergetide.llm.tokens import encoder

MAGIC = b"PFOR0001"
BLOCK = 1024
PERCENTILE = 95
CHUNK = 256  # blocks coded at once
MANIFEST = "shard int, file string, n_docs long, n_tokens long"
_HEAD = struct.Struct("<HBxIHxx")


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Blocks of ids (unsigned, below 2**32); all have BLOCK ids but perhaps the last."""
    out: list[bytes] = [b""] * -(-len(ids) // BLOCK)
    whole = len(ids) // BLOCK
    for first, rows in ((0, ids[: whole * BLOCK].reshape(whole, BLOCK)), (whole, ids[whole * BLOCK :][None, :])):
        if not rows.size:
            continue
        low = rows.min(axis=1).astype(np.uint32)
        rest = rows.astype(np.uint32) - low[:, None]
        typical = np.partition(rest, (k := int((rest.shape[1] - 1) * percentile / 100)), axis=1)[:, k]
        widths = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(np.uint8)
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            some = rest[at]
            bits = ((some[:, :, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
            packed = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
            high = some >> width if width < 32 else np.zeros_like(some)
            for j, i in enumerate(at):
                places = np.flatnonzero(high[j])
                out[first + i] = b"".join(
                    (
                        _HEAD.pack(rows.shape[1], width, low[i], len(places)),
                        packed[j].tobytes(),
                        places.astype("<u2").tobytes(),
                        high[j][places].astype("<u4").tobytes(),
                    )
                )
    return out


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of blocks that begin at these offsets of ``data``."""
    heads = [_HEAD.unpack_from(data, s) for s in starts]
    out = np.zeros((len(heads), BLOCK), np.uint32)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (n, width, _, _) in enumerate(heads):
        groups.setdefault((n, width), []).append(i)
    raw = np.frombuffer(data, np.uint8)
    for (n, width), at in groups.items():
        size = -(-n * width // 8)
        if width:
            packed = np.stack([raw[starts[i] + _HEAD.size : starts[i] + _HEAD.size + size] for i in at])
            bits = np.unpackbits(packed, axis=1, count=n * width, bitorder="little").reshape(len(at), n, width)
            values = np.zeros((len(at), n), np.uint32)
            for b in range(width):
                values |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
            out[at, :n] = values
        for i in at:
            _, _, low, odd = heads[i]
            if odd:
                p = int(starts[i]) + _HEAD.size + size
                places = np.frombuffer(data, "<u2", odd, p)
                out[i, places] |= np.frombuffer(data, "<u4", odd, p + 2 * odd) << np.uint32(width)
            out[i, :n] += np.uint32(low)
    if not heads:
        return np.zeros(0, np.uint32)
    return np.concatenate((out[:-1].ravel(), out[-1, : heads[-1][0]]))


class Writer:
    def __init__(self, stream):
        self.stream, self.at, self.offsets = stream, len(MAGIC), []
        self.ids, self.known, self.lengths, self.waiting, self.pending = [], [], [], [], 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.pending += len(ids)
        if self.pending >= CHUNK * BLOCK:
            self._flush(self.pending // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate([*self.waiting, np.zeros(0, np.uint32)])
        for first in range(0, n, CHUNK * BLOCK):
            for block in pack_blocks(ids[first : min(n, first + CHUNK * BLOCK)]):
                self.offsets.append(self.at)
                self.stream.write(block)
                self.at += len(block)
        self.waiting, self.pending = [ids[n:]], len(ids) - n

    def close(self) -> tuple[int, int]:
        self._flush(self.pending)
        total = sum(self.lengths)
        for values, kind in (([*self.offsets, self.at], "<u8"), (self.ids, "<i8"), (self.known, "u1"), (self.lengths, "<u8")):
            self.stream.write(np.array(values, kind).tobytes())
        self.stream.write(struct.pack("<3Q", len(self.offsets), len(self.ids), total) + MAGIC)
        self.stream.close()
        return len(self.ids), total


class Reader:
    def __init__(self, file):
        self.file = file
        tail = 24 + len(MAGIC)
        file.seek(file.size() - tail)
        end = file.read(tail)
        if end[24:] != MAGIC:
            raise ValueError("not a token file")
        blocks, docs, self.n_tokens = struct.unpack_from("<3Q", end)
        size = 8 * (blocks + 1) + 17 * docs
        file.seek(file.size() - tail - size)
        footer = file.read(size)
        self.offsets = np.frombuffer(footer, "<u8", blocks + 1).astype(np.int64)
        at = 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(footer, "<i8", docs, at)
        self.known = np.frombuffer(footer, "u1", docs, at + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(footer, "<u8", docs, at + 9 * docs).astype(np.int64)

    def read(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from ``start`` on: only the blocks that hold them are read."""
        if count <= 0:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (start + count - 1) // BLOCK + 1
        begin = int(self.offsets[first])
        self.file.seek(begin)
        data = self.file.read(int(self.offsets[last]) - begin)
        ids = unpack_blocks(data, self.offsets[first:last] - begin)
        return ids[start - first * BLOCK : start - first * BLOCK + count]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Document id, place of its first id in the file, ids; some blocks are in memory at a time."""
        start, held, held_from = 0, np.zeros(0, np.uint32), 0
        for doc_id, known, n in zip(self.doc_ids.tolist(), self.known.tolist(), self.lengths.tolist(), strict=True):
            if start + n > held_from + len(held):
                rest = held[start - held_from :]
                want = min(max(CHUNK * BLOCK, n), self.n_tokens - start) - len(rest)
                end = min(self.n_tokens, -(-(start + len(rest) + want) // BLOCK) * BLOCK)
                held = np.concatenate((rest, self.read(start + len(rest), end - start - len(rest))))
                held_from = start
            yield doc_id if known else None, start, held[start - held_from : start - held_from + n]
            start += n


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode every whole text, append ``end_id``, write files in ascending id order; returns the committed manifest.

    A null text is empty, so only ``end_id`` is written. Null ids come first; rows with
    one id stay apart, in order of a hash of their texts. An empty table gives an empty manifest.
    """
    ordered = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("h")
    )
    # Spark samples the order's columns on the driver, so they are numbers, not texts.
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, where = None, f"{uuid.uuid4().hex}.pfor"
        for batch in batches:
            for part in by_bytes(batch, 1):
                if writer is None:
                    system, path = file_system(folder)
                    system.create_dir(path, recursive=True)
                    writer = Writer(system.open_output_stream(f"{path}/{where}", compression=None))
                ids, starts = encoder(tokenizer).encode(part.column(1))
                tail = np.array([end_id], np.uint32)
                for i, name in enumerate(part.column(0).to_pylist()):
                    writer.add(name, np.concatenate((ids[starts[i] : starts[i + 1]], tail)))
        if writer is not None:
            n_docs, n_tokens = writer.close()
            row = [[TaskContext.get().partitionId()], [where], [n_docs], [n_tokens]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                ["shard", "file", "n_docs", "n_tokens"],
            )

    return staged(ordered.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, MANIFEST))


def read_tokens(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), ids (little-endian u32).

    The running sum goes over one row a file, not over documents.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    columns = [pa.field("doc_id", pa.int64()), pa.field("start", pa.int64()), pa.field("ids", pa.binary())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(f"{path}/{name}") as file:
                    rows, size = [], 0
                    for doc_id, start, ids in Reader(file).documents():
                        rows.append((doc_id, first + start, ids.astype("<u4").tobytes()))
                        size += 4 * len(ids)
                        if size > 1 << 22:
                            yield _rows(rows, columns)
                            rows, size = [], 0
                    if rows:
                        yield _rows(rows, columns)

    spread = files.select("file", "first").repartition(max(1, manifest.count()))
    return spread.mapInArrow(read, "doc_id long, start long, ids binary")


def _rows(rows: list[tuple], columns: list[pa.Field]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), columns, strict=True)], [f.name for f in columns]
    )
