"""Spelling variants: words one edit apart, found by a frontier of states moving down a trie.

The trie is a table of nodes and their edges. Prefixes are their own names, so there is
nothing to collide. A state is (word, position, node, edits). Level by level the states at
the nodes of one depth are joined with the edges of these nodes: those without an edit
make one, to any child that can go on, and those with one follow the word exactly. An edge
knows which characters come after it, so that only states with a future are written.

Near the root everything branches, so no edit is made there: an edit in the second half of
a word is looked for in the trie of words, one in the first half in the trie of reversed
words, and a frontier starts where the untouched half ends. Insertions are deletions seen
from the longer word, so states replace or delete only.

Words longer than ``MOST_LEVELS`` would need a level for every character. They are told by
the same edits, one row for each place: two texts that agree but for one place have equal
hashes around it, which the full words then confirm.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergetide.llm.common import ascii_lower, staged

BREAKS = r"[^A-Za-zÀ-ÿ]+"
MOST_LEVELS = 64
LEAST_LENGTH, LEAST_COUNT = 5, 3
DEPTH_ROWS = 4_000_000  # characters of all words for each file of a level; a level holds a fraction of them


def word_runs(text: Column) -> Column:
    """Maximal runs of letters as an array, as they are written, with empty ones between; null text has none."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), BREAKS)


def lowered_run(run: Column) -> Column:
    """A run with A-Z in lower case. Only large letters beyond them would tell this from lower-casing all."""
    return F.when(run.rlike("[À-ÖØ-Þ]"), ascii_lower(run)).otherwise(F.lower(run))


def count_words(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, word: str = "word") -> DataFrame:
    """(word, n): words of at least that many code points that occur often enough; null is no word."""
    long_enough = words.select(F.col(word).alias("word")).where(F.length("word") >= least_length)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def near_words(words: DataFrame, most_levels: int = MOST_LEVELS) -> DataFrame:
    """(word, near): every ordered pair of distinct words that differ by one inserted, deleted or replaced code point.

    ``words`` holds distinct, non-null words in ``word``; other columns are ignored. Words
    of fewer than two code points may be given, and are compared by the same rule.
    """
    words = words.select("word").where("word is not null")
    # A word next to the limit may be near one beyond it, so these are in both parts.
    found = _by_trie(words.where(F.length("word") <= most_levels + 1))
    return found.unionAll(_by_places(words.where(F.length("word") >= most_levels))).distinct()


def _by_trie(words: DataFrame) -> DataFrame:
    """Pairs of ``near_words`` by the trie and its frontier."""
    spark = words.sparkSession
    half = F.expr("length(word) div 2")
    sides = F.inline(
        F.array(
            F.struct(F.lit(0).alias("side"), F.col("word").alias("s"), half.alias("start")),
            F.struct(F.lit(1).alias("side"), F.reverse("word").alias("s"), (F.length("word") - half).alias("start")),
        )
    )
    oriented = staged(words.select(sides))
    deepest, first, rows = oriented.agg(F.max(F.length("s")), F.min("start"), F.sum(F.length("s"))).first()
    if deepest is None:
        return spark.createDataFrame([], "word string, near string")

    def by_depth(df: DataFrame, key: str) -> DataFrame:
        """A folder for each depth, of as many files as its rows need: there are ``rows`` at most, over all depths."""
        parts = F.lit(1 + rows // DEPTH_ROWS)
        return staged(df.repartition("depth", F.pmod(F.xxhash64(key), parts)), "depth")

    # By depth in folders of their own: each level opens its own files, and runs the same compiled code as the last.
    inner = F.expr("filter(sequence(start, length(s)), d -> d < length(s))")
    on_path = oriented.select("side", "s", F.explode(inner).alias("depth"))
    on_path = by_depth(on_path.select("side", "s", "depth", F.expr("substring(s, 1, depth)").alias("node")), "s")
    nodes = by_depth(_trie(oriented, first), "node")
    branches = by_depth(_branches(nodes), "node")

    pairs, moving = [], spark.createDataFrame([], "side int, s string, pos int, node string")
    for depth in range(first, deepest):
        here = on_path.where(F.col("depth") == depth).join(branches.where(F.col("depth") == depth).drop("depth"), ["side", "node"])
        onward = moving.withColumn("node", F.concat("node", _char(F.col("pos")))).join(
            nodes.where(F.col("depth") == depth + 1).drop("depth"), ["side", "node"]
        )
        moved = staged(_edited(here).unionAll(_followed(onward)))
        pairs.append(moved.where(F.col("pos") == F.length("s")).select("side", "s", "node"))
        moving = moved.where(F.col("pos") < F.length("s"))
    found = reduce(DataFrame.unionAll, pairs)
    forward = found.select(
        F.when(F.col("side") == 1, F.reverse("s")).otherwise(F.col("s")).alias("word"),
        F.when(F.col("side") == 1, F.reverse("node")).otherwise(F.col("node")).alias("near"),
    )
    return _both_ways(forward)


def _char(at: Column) -> Column:
    """The character of ``s`` at a place from 0; nothing behind its end."""
    return F.substring("s", at + 1, F.lit(1))


def _goes_on(last: Column, char: Column) -> Column:
    """Whether a state that has used its edit, at a node of which ``ends`` and ``next`` are known, can read the rest of its word."""
    return F.when(last, F.col("ends")).otherwise(F.contains(F.col("next"), char))


def _edited(here: DataFrame) -> DataFrame:
    """From states without an edit at a node, ``depth`` characters in: those an edit here leads to, if they can go on."""
    pos, left = F.col("depth"), F.length("s") - F.col("depth")
    # What a state asks of each kid is worked out once, before its kids.
    told = here.select(
        "side", "s", pos.alias("pos"), "node", left.alias("left"), _char(pos).alias("c0"), _char(pos + 1).alias("c1"), _char(pos + 2).alias("c2"), "kids"
    )
    at = told.select("side", "s", "pos", "node", "left", "c0", "c1", "c2", F.inline("kids"))
    c, real = F.col("c"), F.col("c") != ""
    ended = ~real & (F.col("left") == 1)  # the last character is lost, and a word ends at the node itself
    replaced = real & (c != F.col("c0")) & _goes_on(F.col("left") == 1, F.col("c1"))
    deleted = real & (c == F.col("c1")) & _goes_on(F.col("left") == 2, F.col("c2"))
    moves = at.where(ended | replaced | deleted)
    read = F.when(deleted & replaced, F.array(F.lit(1), F.lit(2))).when(deleted, F.array(F.lit(2))).otherwise(F.array(F.lit(1)))
    return moves.select("side", "s", "pos", "node", "c", F.explode(read).alias("n")).select(
        "side", "s", (F.col("pos") + F.col("n")).alias("pos"), F.concat("node", "c").alias("node")
    )


def _followed(onward: DataFrame) -> DataFrame:
    """States with an edit behind them, one character further; ``node`` and what is known of it are those of the next one."""
    pos = F.col("pos")
    return onward.where(_goes_on(pos + 1 == F.length("s"), _char(pos + 1))).select("side", "s", (F.col("pos") + 1).alias("pos"), "node")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("word"), F.col("near")),
                F.struct(F.col("near").alias("word"), F.col("word").alias("near")),
            )
        )
    )


def _trie(oriented: DataFrame, first: int) -> DataFrame:
    """(side, depth, node, ends, next): nodes from ``first`` on, whether a word ends there, and which characters go on.

    No node has more of them than the alphabet.
    """
    prefixes = oriented.select("side", "s", F.explode(F.sequence(F.lit(first), F.length("s"))).alias("depth")).select(
        "side", F.expr("substring(s, 1, depth)").alias("node"), F.expr("substring(s, depth + 1, 1)").alias("c")
    )
    edges = prefixes.distinct()  # a word's end is an edge without a character
    known = edges.groupBy("side", "node").agg(
        F.max(F.col("c") == "").alias("ends"), F.array_join(F.collect_list("c"), "").alias("next")
    )
    return known.withColumn("depth", F.length("node"))


def _branches(nodes: DataFrame) -> DataFrame:
    """(side, depth, node, kids): the edges of each node together, as (c, ends, next) of where they lead.

    Where a word ends there is one more, without a character.
    """
    up = F.struct(
        F.expr("substring(node, 1, length(node) - 1)").alias("node"),
        F.struct(F.expr("right(node, 1)").alias("c"), F.col("ends"), F.col("next")).alias("kid"),
    )
    own = F.struct(F.col("node"), F.struct(F.lit("").alias("c"), F.lit(True).alias("ends"), F.lit("").alias("next")).alias("kid"))
    below = F.length("node") > 0
    rows = F.when(below & F.col("ends"), F.array(up, own)).when(below, F.array(up)).when(F.col("ends"), F.array(own))
    edges = nodes.select("side", F.inline(rows))
    kids = edges.groupBy("side", "node").agg(F.collect_list("kid").alias("kids"))
    return kids.withColumn("depth", F.length("node"))


def _by_places(words: DataFrame) -> DataFrame:
    """Pairs of ``near_words`` by what is left of a word around each of its places; rows hold numbers, not texts."""
    named = staged(words.select(F.monotonically_increasing_id().alias("id"), "word"))

    def around(gap: int, name: str) -> DataFrame:
        """For each place of a word the hash of what stands before it and of what follows ``gap`` characters on."""

        def halves(i: Column) -> Column:
            return F.xxhash64(F.col("word").substr(F.lit(1), i), F.col("word").substr(i + (1 + gap), F.length("word")))

        places = F.sequence(F.lit(0), F.length("word") - gap)
        size = (F.length("word") + (1 - gap)).alias("size")  # of the longer word
        return named.select(F.col("id").alias(name), size, F.posexplode(F.transform(places, halves)).alias("place", "h"))

    left = around(1, "a")
    key = ["size", "place", "h"]
    shorter = left.join(around(0, "b"), key).select("a", "b")
    # No more words than the alphabet has characters leave the same around one place.
    replaced = left.join(around(1, "b"), key).where("a < b").select("a", "b")
    text = named.select(F.col("id").alias("b"), F.col("word").alias("near"))
    pairs = shorter.unionAll(replaced).distinct().join(named.withColumnRenamed("id", "a"), "a").join(text, "b")
    confirmed = pairs.where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
    return _both_ways(confirmed.select("word", "near"))


def variants(words: DataFrame, ratio: int = 2, most_levels: int = MOST_LEVELS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    A word's form is its near word of largest n, of equal ones the first in code-point
    order, if that n is ``ratio`` times its own at least; else null, and form_n too. Its
    root is the last word that forms lead to, itself if none. ``ratio`` must be above 1,
    so that forms cannot lead in a circle. Rows without word or n are left out; a word
    given twice counts once, with its n added up. An empty table gives none.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    counted = staged(words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    near = near_words(counted, most_levels)
    most = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("first")
    best = (
        near.join(counted.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), most)
    )
    formed = F.coalesce(-F.col("first.less") >= ratio * F.col("n"), F.lit(False))
    told = staged(
        counted.join(best, "word", "left").select(
            "word",
            F.when(formed, F.col("first.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, -F.col("first.less")).cast("long").alias("form_n"),
        )
    )
    roots = _roots(told.where("form is not null").select("word", F.col("form").alias("root")))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of links that lead in no circle: each step doubles how far a link reaches."""
    links = staged(links)
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = staged(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if joined.where("moved").isEmpty():
            return joined.select("word", "root")
        links = joined.select("word", "root")
