"""What several of the operators share."""

from __future__ import annotations

import uuid

from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergetide.session import shared_dir

# Words are runs of anything but ASCII white space; bytes.split() cuts at the same six characters.
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def staged(df: DataFrame, *partitions: str) -> DataFrame:
    """The rows written to a fresh shared folder and read back: computed once, lineage cut, sizes known to the planner.

    With ``partitions`` a read that asks for some of their values opens no other files; deal the
    rows out by them first, or every task writes a file for each value it holds.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partitions) if partitions else df.write
    writer.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a folder every executor reaches, and the path in it."""
    return arrow_fs.FileSystem.from_uri(uri)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def word_shingles(words: Column, k: int) -> Column:
    """64-bit hashes of the k-word windows in order; with fewer words the whole sequence is one; none without words."""
    n = F.size(words)
    spans = F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))
    hashes = F.transform(spans, lambda i: F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(k)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(hashes)
