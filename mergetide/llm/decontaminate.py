"""Benchmark decontamination: which documents contain which test items.

An item is looked for by MinHash containment. Items are partitioned by size (powers of
two), and each partition keeps as many of an item's least shingle hashes as any document
that holds ``percent`` of the item must share at least one of: it may miss a quarter of
the shingles and no more. So the search finds short items in documents of any length
and loses none. What it finds is verified on the shingles themselves, as text.

The sketch is written first, so that Spark broadcasts it only if its measured size allows
and joins by hash otherwise. All of it is DataFrame expressions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergetide.llm.common import ascii_lower, staged, word_shingles, words_of

SHINGLE = 5
PERCENT = 75


def _words(text: str) -> Column:
    return words_of(ascii_lower(F.col(text).cast("string")))


def _shingle_texts(words: Column, k: int) -> Column:
    """The distinct k-word shingles as text; with fewer words the whole sequence is one."""
    spans = F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))
    texts = F.array_distinct(F.transform(spans, lambda i: F.array_join(F.slice(words, i, k), " ")))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(texts)


def sketch(items: DataFrame, item_id: str, text: str, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """(item_id, partition, hash): the least hashes of each item, as many as its size partition needs."""
    hashed = items.select(F.col(item_id).alias("item_id"), _words(text).alias("words")).select(
        "item_id", F.array_sort(F.array_distinct(word_shingles(F.col("words"), k))).alias("hashes")
    )
    partition = F.floor(F.log2(F.size("hashes"))).cast("int")
    largest = F.pow(F.lit(2), F.col("partition") + 1) - 1
    needed = (F.floor(largest * (100 - percent) / 100) + 1).cast("int")
    sized = hashed.where(F.size("hashes") > 0).withColumn("partition", partition)
    return sized.select("item_id", "partition", F.explode(F.slice("hashes", F.lit(1), needed)).alias("hash"))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    percent: int = PERCENT,
    k: int = SHINGLE,
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) for every document holding ``percent`` of an item's shingles or more.

    Shingles are k words, A-Z lower-cased. An item of fewer than k words is one shingle,
    and so is a document: a short item is found in a document that is the same words.
    Null and empty texts hold nothing and are in nothing. Rows with one id (or without
    one) are taken as one document or item. Empty tables give an empty one.
    """
    parts = staged(sketch(items, item_id, item_text, percent, k))
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    hashes = named.select("doc_id", _words("text").alias("words")).select(
        "doc_id", F.explode(word_shingles(F.col("words"), k)).alias("hash")
    )
    candidates = hashes.join(parts, "hash").select("doc_id", "item_id").distinct()
    candidates = staged(candidates)

    wanted = candidates.select(F.col("doc_id").alias("_doc")).distinct()
    hit = named.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    held = hit.select("doc_id", _words("text").alias("words")).select(
        "doc_id", F.explode(_shingle_texts(F.col("words"), k)).alias("shingle")
    )
    whole = items.select(F.col(item_id).alias("item_id"), _words(item_text).alias("words")).select(
        "item_id", F.explode(_shingle_texts(F.col("words"), k)).alias("shingle")
    )
    whole = staged(whole.distinct())
    sizes = whole.groupBy("item_id").agg(F.count("*").alias("n_item")).withColumnRenamed("item_id", "_item")
    shared = held.join(whole, "shingle").select("doc_id", "item_id", "shingle").distinct()
    counted = shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    found = counted.join(sizes, F.col("item_id").eqNullSafe(F.col("_item")))
    return found.where(100 * F.col("n_shared") >= percent * F.col("n_item")).select("doc_id", "item_id", "n_item", "n_shared")


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that contain an item. Rows with one id go together; each row without an id is judged by its own text.

    Columns may have any name and type.
    """
    bad_id, bad_digest = (f"_{uuid.uuid4().hex}" for _ in range(2))  # names no column has
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # Equal texts hold the same items, so the text's digest names a row without id.
    named = docs.select(
        F.struct(F.col(doc_id).alias("id"), F.when(F.col(doc_id).isNull(), F.sha2(body, 256)).alias("digest")).alias("key"),
        F.col(text).alias("text"),
    )
    found = contained_items(named, items, "key", "text").select("doc_id.id", "doc_id.digest").distinct()
    bad = staged(found)
    of_id = bad.where("id is not null").select(F.col("id").alias(bad_id))
    of_text = bad.where("id is null").select(F.col("digest").alias(bad_digest))
    clean = docs.where(F.col(doc_id).isNotNull()).join(of_id, F.col(doc_id) == F.col(bad_id), "left_anti")
    nameless = docs.where(F.col(doc_id).isNull()).join(of_text, F.sha2(body, 256) == F.col(bad_digest), "left_anti")
    return clean.unionAll(nameless)
