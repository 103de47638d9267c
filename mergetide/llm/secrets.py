"""Secret scans with corpus-wide ownership.

Patterns find candidates in every whole text; what a value is worth is settled by who
has it. Each value's distinct repositories and owners are counted over the corpus:
a value that many of them hold is a copied example, one held by few that also looks
random is a live credential. Bare random-looking strings, which no keyword gives away,
become spans only when that verdict makes them live.

Positions come from the regular expression engine itself: the texts between the matches
and the matches, in order, add up to the places of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergetide.llm.common import staged

# The patterns of the base kinds, with the least length of the value (of group 2, or of the match).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = "AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 or more: the rest of a shorter run holds no longer match
HEX = "[0-9a-f]{16,}"
BARE = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "bare")
MAX_REPOSITORIES, MAX_OWNERS = 3, 3
_BLOCK = 512


def _starts(steps: Column, i: Column) -> Column:
    """The sum of the first i + 1 steps, by sums of blocks, so that many matches do not cost their square."""
    block = F.floor(i / _BLOCK).cast("int")

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, b: a + b)

    return total(F.slice(steps["blocks"], F.lit(1), block)) + total(
        F.slice(steps["each"], block * _BLOCK + 1, i - block * _BLOCK + 1)
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str = "source", owner: str = "source") -> DataFrame:
    """doc_id, repository, owner and ``candidates``: array of (start, kind, end, value), one row for each document."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(repository).cast("string").alias("repository"),
        F.col(owner).cast("string").alias("owner"),
        body.alias("text"),
    )
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, BARE), strict=True))
    base = ["doc_id", "repository", "owner"]
    found = named.select(*base, "text", *[F.regexp_extract_all("text", F.lit(p), 0).alias(f"{k}_m") for k, p in patterns.items()])

    def steps(kind: str) -> Column:
        gaps = F.split(F.col("text"), patterns[kind], -1)
        each = F.zip_with(
            F.transform(gaps, F.length),
            F.concat(F.array(F.lit(0)), F.transform(f"{kind}_m", F.length)),
            lambda gap, before: gap + before,
        )
        return F.when(F.size(f"{kind}_m") > 0, each).alias(f"{kind}_s")

    stepped = found.select(*base, *[f"{k}_m" for k in KINDS], *[steps(k) for k in KINDS])

    def blocks(kind: str) -> Column:
        each = F.col(f"{kind}_s")
        numbers = F.sequence(F.lit(0), F.floor(F.size(each) / _BLOCK).cast("int"))
        sums = F.transform(
            numbers, lambda b: F.aggregate(F.slice(each, b * _BLOCK + 1, _BLOCK), F.lit(0), lambda x, y: x + y)
        )
        return F.when(each.isNotNull(), F.struct(each.alias("each"), sums.alias("blocks"))).alias(f"{kind}_s")

    summed = stepped.select(*base, *[f"{k}_m" for k in KINDS], *[blocks(k) for k in KINDS])

    def spans(kind: str) -> Column:
        def span(match: Column, i: Column) -> Column:
            start = _starts(F.col(f"{kind}_s"), i)
            value = F.regexp_extract(match, ASSIGN, 2) if kind == "assign" else match
            return F.struct(
                start.alias("start"),
                F.lit(KINDS.index(kind)).alias("kind"),
                (start + F.length(match)).alias("end"),
                value.alias("value"),
            )

        made = F.transform(f"{kind}_m", span)
        if kind == "assign":
            made = F.filter(made, lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
        empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
        return F.when(F.size(f"{kind}_m") > 0, made).otherwise(empty)

    kept = summed.select(*base, F.concat(*[spans(k) for k in KINDS[:3]]).alias("sure"), spans("bare").alias("bare"))
    free = F.filter(
        "bare",
        lambda b: looks_random(b["value"])
        & ~F.exists("sure", lambda s: (s["start"] < b["end"]) & (b["start"] < s["end"])),
    )
    return kept.select(*base, F.concat("sure", free).alias("candidates"))


def looks_random(value: Column) -> Column:
    """Three digits or more, letters in both cases, ten different characters or more."""
    different = F.size(F.array_distinct(F.split(value, "")))
    digits = F.length(value) - F.length(F.translate(value, "0123456789", ""))
    return (digits >= 3) & value.rlike("[A-Z]") & value.rlike("[a-z]") & (different >= 10)


def looks_live(value: Column) -> Column:
    """Letters and digits, eight different characters or more."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def find_secrets(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    repository: str = "source",
    owner: str = "source",
    max_repositories: int = MAX_REPOSITORIES,
    max_owners: int = MAX_OWNERS,
) -> DataFrame:
    """doc_id and ``spans``, one row for each row of ``docs``: array of (start, kind, end, n_repositories, n_owners, live).

    Kinds are numbers into ``KINDS``; places are code points, the end exclusive; spans
    are in order of start, then kind. All matches of the base kinds are spans, with the
    verdict beside; bare strings are if they are live. A null text is empty, and nulls
    among repositories and owners are not counted. Rows with one id stay apart; an empty
    table gives an empty one.
    """
    scanned = staged(scan(docs, doc_id, text, repository, owner).withColumn("row", F.monotonically_increasing_id()))
    each = scanned.where(F.size("candidates") > 0).select("row", "doc_id", "repository", "owner", F.explode("candidates").alias("c"))
    value = F.sha2("c.value", 256).alias("value_hash")
    holders = (
        each.select(value, "repository", "owner")
        .groupBy("value_hash")
        .agg(F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"))
    )
    few = (F.col("n_repositories") <= max_repositories) & (F.col("n_owners") <= max_owners)
    judged = each.select("row", "doc_id", "c", value).join(holders, "value_hash").withColumn("live", few & looks_live(F.col("c.value")))
    wanted = judged.where((F.col("c.kind") < 3) | F.col("live"))
    span = F.struct("c.start", "c.kind", "c.end", "n_repositories", "n_owners", "live")
    with_spans = wanted.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    out = scanned.select("row", "doc_id").join(with_spans, "row", "left")
    kind = with_spans.schema["spans"].dataType
    return out.select("doc_id", F.coalesce("spans", F.array().cast(kind)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    )
