"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergetide.llm import decontaminate, hard_negatives, html_text, neardup, oracle, packing, pii, quality, quality_classifier, secrets, spelling, token_counts, token_files, warc
from mergetide.llm.common import new_folder, staged
from mergetide.session import configure

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
PACK_END, FILE_END, TOKEN_LIMIT = 1, 2, 512
KEY_SETTING = "spark.mergetide.pseudonymKey"


def tokenizer(name: str) -> str:
    """The place of a tokenizer file; a folder in MERGETIDE_TOKENIZERS takes the place of the package's."""
    folder = os.environ.get("MERGETIDE_TOKENIZERS")
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


def pseudonym_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, "not-a-secret")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, tokenizer(WORD_BPE), PACK_END, digest=True)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    featured = staged(quality.with_features(docs.select("doc_id", "lang", "text")).drop("text"))
    cutoffs = staged(quality.certified_cutoffs(featured, labels))
    counts = [F.col(f"quality_{c}").alias(c) for c in (*quality.COUNTS, "base_failed", "kept")]
    return quality.judge(featured, cutoffs).select("doc_id", *counts)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    manifest = token_files.write_tokens(_table(spark, sf_dir, "documents"), folder, tokenizer(BYTE_BPE), FILE_END)
    n_tokens = F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return token_files.read_tokens(spark, manifest, folder).select("doc_id", "start", n_tokens, F.crc32("ids").alias("ids_crc32"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pseudonym_key(spark))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    extracted = html_text.extract(_table(spark, sf_dir, "pages"))
    return extracted.withColumn("n_chars", F.length("text").cast("long"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def of_kind(name: str) -> Column:
        number = secrets.KINDS.index(name)
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long").alias(f"n_{name}")

    return found.select(
        "doc_id",
        *[of_kind(k) for k in secrets.KINDS[:3]],
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def op9_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.whole_vectors(_table(spark, sf_dir, "embeddings"), shifted)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def noisy_words(docs: DataFrame, least_length: int = 1) -> DataFrame:
    """The words of whole texts, one in 97 of them, told by a checksum, without one of its code points.

    Runs shorter than ``least_length`` are left out before anything is done to them.
    """
    run, h = F.col("run"), F.col("h")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(name.alias("id"), F.explode(spelling.word_runs(F.col("text"))).alias("run")).where(F.length(run) >= least_length)
    lowered = runs.select("id", spelling.lowered_run(run).alias("run"))
    # A generator, so that no filter on the words is given a copy of the checksum.
    summed = lowered.select(F.inline(F.array(F.struct("run", F.crc32(F.concat("id", F.lit(":"), run)).alias("h")))))
    place = (h % F.length(run)).cast("int")
    cut = F.concat(run.substr(F.lit(1), place), run.substr(place + 2, F.length(run)))
    return summed.select(F.when(h % 97 == 0, cut).otherwise(run).alias("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(noisy_words(_table(spark, sf_dir, "documents"), spelling.LEAST_LENGTH)))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    scored = quality_classifier.quality_scores(docs.withColumn("held_out", held_out), labels, ~held_out, ["doc_id", "held_out"])
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


QUERIES = {
    q.__name__: q
    for q in (
        op1_packing,
        op2_near_duplicates,
        op3_quality_rules,
        op4_token_files,
        op5_pseudonyms,
        op6_main_text,
        op7_decontamination,
        op8_secret_scan,
        op9_archives,
        op10_token_counts,
        op11_hard_negatives,
        op12_spelling_variants,
        op13_quality_classifier,
    )
}
# The others hold a tokenizer, keyed digests or fitted trees; tests compare them with plain Python instead.
ORACLE_SQL: dict[str, str] = oracle.SQL
