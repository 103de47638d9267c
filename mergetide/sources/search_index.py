"""A stored index for ranked full-text search.

Documents are split into words once, when they are added. The index keeps a row for every
document and word (with how often it occurs, and the document's length) in folders by the
hash of the word, and a row of totals for every batch. A query opens the folders of its
own words, skips what else is in them by Parquet statistics, and reads no text. Batches
become visible by commit records, like those of a store, and are merged the same way.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergetide.functions.text import words
from mergetide.operators.search import bm25_weight, query_terms
from mergetide.sources import commits

POSTINGS = "term string, id bigint, tf int, length int, bucket int"
TOTALS = "documents bigint, words bigint"


@dataclass(frozen=True)
class SearchIndex:
    """``buckets``: folders for the words of a batch. It stays what it was when the index was made."""

    root: str
    buckets: int = 32

    @property
    def home(self) -> str:
        return self.root.rstrip("/")

    def bucket(self, term: str | Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")


def document_postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, length, place, term, tf)`` for every word of every whole text, a document without words as one row without term.

    ``place`` counts a document's words from 0.
    Counted inside each row: equal words stand side by side in the sorted array, so a run's
    length is its count. No shuffle, and no row per occurrence.
    """
    sorted_ = docs.select(F.col(id_col).cast("long").alias("id"), F.sort_array(words(text_col)).alias("w"))
    # A generator between the steps, so that no later expression is given a copy of the sort.
    sorted_ = sorted_.select("id", F.inline(F.array(F.struct("w", F.size("w").alias("length")))))
    places = F.when(F.col("length") > 0, F.sequence(F.lit(0), F.col("length") - 1)).otherwise(F.array().cast("array<int>"))
    first = F.filter(places, lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    runs = sorted_.select("id", "length", F.inline(F.array(F.struct("w", first.alias("begins")))))
    counted = F.transform(
        "begins", lambda at, i: F.struct(F.get("w", at).alias("term"), (F.coalesce(F.get("begins", i + 1), F.col("length")) - at).alias("tf"))
    )
    told = runs.select("id", "length", F.posexplode_outer(counted).alias("place", "x"))
    return told.select("id", "length", F.coalesce("place", F.lit(0)).alias("place"), "x.term", F.col("x.tf").cast("int").alias("tf"))


def _write_postings(postings: DataFrame, index: SearchIndex, part: str) -> None:
    laid = postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id")
    commits.write_part(laid, index.home, "postings", part, "bucket")


def add_documents(
    docs: DataFrame, index: SearchIndex, id_col: str, text_col: str, writer: str | None = None, step: int = 0
) -> int:
    """Adds a batch of documents, seen by searches from its commit on; returns its number.

    A document is added once: its id is not looked up among those there. Rows without id
    are left out. Under a ``writer``'s name a step that broke off, or is repeated, counts once.
    """
    spark = docs.sparkSession
    number = commits.claim_number(spark, index.home, writer or f"once-{uuid.uuid4()}", step)
    if commits.is_committed(spark, index.home, number):
        return number
    part = commits.batch_part(number)
    counted = document_postings(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    staged = f"{index.home}/staged/{part}"
    counted.write.mode("overwrite").parquet(staged)  # text is read and split once
    counted = spark.read.schema(counted.schema).parquet(staged)
    postings = counted.where(F.col("term").isNotNull()).select("term", "id", "tf", "length", index.bucket("term").alias("bucket"))
    _write_postings(postings, index, part)
    totals = counted.agg(
        F.count_if(F.col("place") == 0).alias("documents"), F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("words")
    )
    commits.write_part(totals, index.home, "totals", part)
    commits.commit_batch(spark, index.home, number)
    return number


def score_documents(spark: SparkSession, index: SearchIndex, query: str) -> DataFrame:
    """``(id, score)`` of every document with a word of the query: the same as ``operators.search.bm25``.

    Word frequencies and totals are those of all committed batches. The parts of a score
    are added up in the order of the query's words, so the order of rows plays no role.
    """
    terms = query_terms(spark, query)
    of = commits.parts(spark, index.home).live
    postings = commits.read_parts(spark, index.home, "postings", POSTINGS, of)
    if not terms:
        return postings.select("id", F.lit(None).cast("double").alias("score")).where(F.lit(False))
    folders = sorted({r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(index.bucket(F.col("t"))).collect()})
    found = postings.where(F.col("bucket").isin(folders) & F.col("term").isin(terms))

    held = found.agg(F.array(*[F.count_if(F.col("term") == t) for t in terms]).alias("df"))
    totals = commits.read_parts(spark, index.home, "totals", TOTALS, of).agg(
        F.struct(F.sum("documents").alias("n"), (F.sum("words") / F.sum("documents")).alias("mean_length")).alias("totals")
    )
    place = F.array_position(F.lit(terms), F.col("term")).cast("int")
    weight = bm25_weight(
        F.col("tf"), F.col("length"), F.col("_totals.n"), F.col("_totals.mean_length"), F.element_at("_df", place)
    )
    known = found.withColumns({"_df": held.scalar(), "_totals": totals.scalar()})
    scored = known.select("id", "term", weight.alias("part"))
    parts = [F.coalesce(F.sum(F.when(F.col("term") == t, F.col("part"))), F.lit(0.0)) for t in terms]
    return scored.groupBy("id").agg(reduce(lambda a, b: a + b, parts).alias("score"))


def search_index(spark: SparkSession, index: SearchIndex, query: str, k: int = 10) -> DataFrame:
    """The ``k`` best documents, ties by id."""
    return score_documents(spark, index, query).orderBy(F.desc("score"), F.asc("id")).limit(k)


def merge_batches(spark: SparkSession, index: SearchIndex) -> bool:
    """Moves the postings of all batches into one part, so that a query opens few files. False if there is nothing to gain."""
    seen = commits.parts(spark, index.home)
    old = seen.live
    if len(old) < 2:
        return False
    part = f"c{uuid.uuid4().hex}"
    _write_postings(commits.read_parts(spark, index.home, "postings", POSTINGS, old), index, part)
    commits.write_part(commits.read_parts(spark, index.home, "totals", TOTALS, old).coalesce(1), index.home, "totals", part)
    return commits.commit_merge(spark, index.home, seen, part, [*seen.gone, *old])
