"""Where results go: files from the executors, or, if small, Arrow and pandas on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

FORMATS = ("parquet", "csv", "json")


def export(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """Write from the executors to a folder on any file system Spark reaches, object stores included."""
    if fmt not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}")
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    elif fmt == "json":
        writer = writer.option("ignoreNullFields", False)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)


def small_arrow(df: DataFrame, max_rows: int = 1_000_000) -> pa.Table:
    """A small result as an Arrow table in the result's order, with its schema also when empty.

    One run of the query; at most ``max_rows`` and one more row reach the driver. A larger
    result is refused, not cut: ``export`` it, from where Arrow readers take it as Parquet.
    """
    table = df.limit(max_rows + 1).toArrow()
    _refuse(table.num_rows, max_rows)
    return table


def small_pandas(df: DataFrame, max_rows: int = 1_000_000):
    """A small result as a pandas frame. Larger ones are refused, not cut."""
    frame = df.limit(max_rows + 1).toPandas()
    _refuse(len(frame), max_rows)
    return frame


def _refuse(n: int, max_rows: int) -> None:
    if n > max_rows:
        raise ValueError(f"more than {max_rows} rows: export() them instead")
