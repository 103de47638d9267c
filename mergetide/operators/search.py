"""Ranked full-text search (Okapi BM25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergetide.functions.text import words

# Fixed values of the published formula.
K1 = 1.2
B = 0.75


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The distinct words of a query, split as documents are, by the same expression."""
    return spark.range(1).select(F.array_distinct(words(F.lit(query)))).first()[0]


def bm25_weight(tf: Column, length: Column, n: Column, mean_length: Column, df: Column) -> Column:
    """What one word adds to a document's score."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def term_counts(docs: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """``(id, length, tf)`` of every document: its number of words and how often each term occurs.

    Counted inside each row from its whole text; documents are never exploded into words.
    """

    def occurrences(term: str) -> Column:
        return F.size("_words") - F.size(F.array_remove("_words", term))

    counts = F.struct(F.size("_words").alias("length"), F.array(*[occurrences(t) for t in terms]).alias("tf"))
    # As generator input: a filter on the counts cannot be moved below and split the text once more.
    return docs.select(id_col, words(text_col).alias("_words")).select(id_col, F.inline(F.array(counts)))


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str, stage: str | None = None) -> DataFrame:
    """``(id, score)`` of every document with a word of the query.

    score = sum over query words of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)),
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)). No stemming, no stop words.

    Nothing but one row of totals is shuffled; it reaches the scoring pass as a
    scalar subquery. Text is read twice, or once if ``stage`` names a folder to
    keep the counts in: a few bytes per document.
    """
    terms = query_terms(docs.sparkSession, query)
    if not terms:
        return docs.select(id_col, F.lit(None).cast("double").alias("score")).where(F.lit(False))
    counts = term_counts(docs, id_col, text_col, terms)
    if stage:
        counts.write.mode("overwrite").parquet(stage)
        counts = docs.sparkSession.read.schema(counts.schema).parquet(stage)

    totals = counts.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.avg("length").alias("mean_length"),
            F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(len(terms))]).alias("df"),
        ).alias("totals")
    )
    total = F.col("_totals")

    def part(i: int) -> Column:
        tf = F.col("tf")[i]
        weight = bm25_weight(tf, F.col("length"), total["n"], total["mean_length"], total["df"][i])
        return F.when(tf > 0, weight).otherwise(0.0)

    score = part(0)
    for i in range(1, len(terms)):
        score = score + part(i)
    return counts.where(F.array_max("tf") > 0).withColumn("_totals", totals.scalar()).select(id_col, score.alias("score"))


def search(
    docs: DataFrame, id_col: str, text_col: str, query: str, k: int = 10, stage: str | None = None
) -> DataFrame:
    """The ``k`` best documents, ties by id."""
    return bm25(docs, id_col, text_col, query, stage).orderBy(F.desc("score"), F.asc(id_col)).limit(k)
