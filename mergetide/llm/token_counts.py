"""Token counts: Arrow batches go in, lengths only come out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergetide.llm.tokens import encoder

# Texts of one call are held to about this many bytes, however many rows that is.
CALL_BYTES = 8 << 20


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_bytes`` (UTF-8) and ``n_tokens`` of every whole text, as the library counts.

    No special tokens are added; the file's special strings inside a text count as the
    library's default has it. A null text is empty: 0 and 0. Rows are kept as they are,
    repeated ones too; an empty table gives an empty one. Columns not in ``keep`` are
    left out, and a kept column named like a result gives way to it.
    """
    keep = tuple(k for k in keep if k not in ("n_bytes", "n_tokens"))
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_tokens")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, len(keep)):
                texts = part.column(len(keep))
                sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                counts = pa.array(encoder(tokenizer).count(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], sizes, counts], [*keep, "n_bytes", "n_tokens"])

    return docs.select(*keep, F.col(text).cast("string").alias("_text_")).mapInArrow(count, schema)


def by_bytes(batch: pa.RecordBatch, column: int, most: int = CALL_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in stretches of rows whose texts come to ``most`` bytes, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if len(sizes) > begin:
        yield batch.slice(begin, len(sizes) - begin)
