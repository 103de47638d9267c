"""Quality rules whose cutoffs carry a guarantee.

Fixed rules come first (too few words, too much repetition). The others compare a
statistic with a cutoff, and the cutoffs are not chosen by hand: for every stratum, each
candidate is tested on the labelled holdout. The null hypothesis is that the rule rejects
more than ``risk`` of the good documents; the exact binomial tail of the good ones it
rejected is its p-value, and Bonferroni's correction goes over all candidates of a stratum.
A rule takes the sharpest candidate that is certified, or none, so a stratum without
enough labels keeps its documents.

All of it is DataFrame expressions. Statistics are whole numbers, larger being worse.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergetide.llm.common import staged, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
RISK = 0.005
LEVEL = 0.05
# Candidates for each rule's cutoff, sharpest first, in thousandths.
CUTOFFS = {
    "symbols": (10, 30, 100),  # symbols to characters of words
    "duplicate_lines": (250, 350, 500),  # to lines with a word
    "repeated_words": (200, 300, 400),  # to words
    "long_words": (7000, 8000, 10000),  # characters to words
    "short_words": (280, 320, 360),  # words to characters
    "capitals": (100, 200, 400),  # A-Z to characters of words
    "shouts": (100, 300, 800),  # exclamation marks to words
}
SYMBOLS = "[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_features(docs: DataFrame, text: str = "text", prefix: str = "quality_") -> DataFrame:
    """Adds ``prefix`` columns: the counts, ``base_failed`` and the statistics of each whole text. A null text has no words.

    Repeated words are those in three-word windows that occur twice or more, the first
    occurrence included, each word counted once.
    """
    own, p = docs.columns, prefix
    words, lines, grams, ordered = (F.col(f"{p}{n}") for n in ("words", "lines", "grams", "ordered"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def times(pattern: str) -> Column:
        return F.regexp_count(body, F.lit(pattern)).cast("long")

    has_word = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.withColumns({f"{p}words": words_of(body), f"{p}lines": has_word})
    spans = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(spans, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    counted = split.select(
        *own,
        F.size(words).cast("long").alias(f"{p}n_words"),
        F.length(F.array_join(words, "")).cast("long").alias(f"{p}word_chars"),
        times(SYMBOLS).alias(f"{p}n_symbols"),
        F.size(lines).cast("long").alias(f"{p}n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(f"{p}n_dup_lines"),
        times("[A-Z]").alias(f"{p}n_capitals"),
        times("!").alias(f"{p}n_shouts"),
        F.when(F.size(words) >= 3, hashes).otherwise(F.array().cast("array<bigint>")).alias(f"{p}grams"),
    )
    # Only texts that repeat a window sort theirs: equal windows then stand side by side.
    repeats = F.size(F.array_distinct(grams)) < F.size(grams)
    marked = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    kept = [c for c in counted.columns if c != f"{p}grams"]
    sorted_ = counted.select(*kept, F.when(repeats, marked).alias(f"{p}ordered"))
    twice = F.filter(ordered, lambda x, i: _equal(x, F.get(ordered, i - 1)) | _equal(x, F.get(ordered, i + 1)))
    covered = F.aggregate(
        F.array_sort(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda seen, i: F.struct((seen["n"] + F.least(F.lit(3), i - seen["last"])).alias("n"), i.alias("last")),
        lambda seen: seen["n"],
    )
    whole = sorted_.select(*kept, F.coalesce(covered, F.lit(0).cast("long")).alias(f"{p}n_repeat_words"))
    made = whole.select("*", *_statistics(p))
    # A generator stands between the features and what uses them: a filter pushed below the
    # expressions would be given copies of them, down to the sort inside a loop over words.
    names = [c for c in made.columns if c.startswith(p)]
    return made.select(*own, F.inline(F.array(F.struct(*names))))


def _equal(a: Column, b: Column) -> Column:
    return F.coalesce(a["h"] == b["h"], F.lit(False))


def _statistics(prefix: str) -> list[Column]:
    def count(name: str) -> Column:
        return F.col(f"{prefix}{name}")

    def per_mille(part: str, whole: str, name: str) -> Column:
        return F.floor(1000 * count(part) / F.greatest(count(whole), F.lit(1))).cast("long").alias(f"{prefix}{name}")

    failed = (count("n_words") < MIN_WORDS) | (100 * count("n_repeat_words") > MAX_REPEAT_PERCENT * count("n_words"))
    return [
        failed.alias(f"{prefix}base_failed"),
        per_mille("n_symbols", "word_chars", "symbols"),
        per_mille("n_dup_lines", "n_lines", "duplicate_lines"),
        per_mille("n_repeat_words", "n_words", "repeated_words"),
        per_mille("word_chars", "n_words", "long_words"),
        per_mille("n_words", "word_chars", "short_words"),
        per_mille("n_capitals", "word_chars", "capitals"),
        per_mille("n_shouts", "n_words", "shouts"),
    ]


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of n trials with chance p, to double precision.

    From the mass at k the terms below it shrink by a known ratio; they are added until
    far beyond what a double can show, so the work grows with the root of n at most.
    From the mean on the tail is about a half or more, which is told as 1.
    """

    def log_factorial(x: Column) -> Column:
        y = x + 9  # Stirling's series needs room: gamma(x + 1) = gamma(x + 9) / ((x + 1) ... (x + 8))
        shift = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(0.0), lambda s, i: s + F.log(x + i))
        series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
        return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift

    mass = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    terms = F.least(k, F.ceil(12 * F.sqrt(n * p)) + 60)
    added = F.aggregate(
        F.sequence(F.lit(0).cast("long"), terms.cast("long")),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda s, i: F.struct(
            (s["term"] * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("term"), (s["total"] + s["term"]).alias("total")
        ),
        lambda s: s["total"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), mass * added))


def certified_cutoffs(
    featured: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    doc_id: str = "doc_id",
    quality: str = "quality",
    prefix: str = "quality_",
    risk: float = RISK,
    level: float = LEVEL,
) -> DataFrame:
    """A row for each stratum with a holdout: ``stratum`` and for each rule its certified cutoff, or null.

    The holdout is the labelled documents the fixed rules pass. A document labelled twice
    is good if any label says so, which can only make cutoffs milder. With probability
    1 - ``level`` no rule of a stratum rejects more than ``risk`` of its good documents.
    """
    good = (
        labels.select(F.col(doc_id).alias("_id"), F.col(quality).alias("_good"))
        .groupBy("_id")
        .agg(F.max("_good").alias("_good"))
        .where("_good = 1")
    )
    slim = featured.select(
        F.col(doc_id).alias("_id"), F.col(stratum).cast("string").alias("stratum"), f"{prefix}base_failed",
        *[F.col(f"{prefix}{r}").alias(r) for r in CUTOFFS],
    )
    holdout = slim.where(~F.col(f"{prefix}base_failed")).join(good, "_id")
    tests = [(rule, cutoff) for rule, cutoffs in CUTOFFS.items() for cutoff in cutoffs]
    counted = holdout.groupBy("stratum").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(rule) > cutoff).alias(f"{rule}_{cutoff}") for rule, cutoff in tests],
    )
    rows = F.explode(
        F.array(
            *[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}_{c}").alias("k")) for r, c in tests]
        )
    )
    tested = counted.select("stratum", "n", rows.alias("t")).select("stratum", "n", "t.*")
    passed = tested.where(binomial_tail(F.col("k"), F.col("n"), risk) <= level / len(tests))
    return passed.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in CUTOFFS])


def judge(featured: DataFrame, cutoffs: DataFrame, stratum: str = "lang", prefix: str = "quality_") -> DataFrame:
    """``featured`` with ``prefix`` + kept: false if a fixed rule or a certified one rejects the document."""
    limits = cutoffs.select(F.col("stratum").alias(f"{prefix}of"), *[F.col(r).alias(f"{prefix}most_{r}") for r in CUTOFFS])
    joined = featured.join(limits, F.col(stratum).cast("string").eqNullSafe(F.col(f"{prefix}of")), "left")
    rejected = F.col(f"{prefix}base_failed")
    for r in CUTOFFS:
        rejected = rejected | F.coalesce(F.col(f"{prefix}{r}") > F.col(f"{prefix}most_{r}"), F.lit(False))
    return joined.select(*featured.columns, (~rejected).alias(f"{prefix}kept"))


def free_prefix(df: DataFrame, prefix: str = "quality_") -> str:
    """A prefix none of the table's columns has."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    return prefix


def quality_filter(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text") -> DataFrame:
    """The documents that pass, with their columns as they came."""
    prefix = free_prefix(docs)
    featured = with_features(docs, text, prefix)
    cutoffs = staged(certified_cutoffs(featured, labels, stratum, prefix=prefix))
    return judge(featured, cutoffs, stratum, prefix).where(F.col(f"{prefix}kept")).select(*docs.columns)
