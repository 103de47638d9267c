"""Spelling variants against brute force."""

import collections
import itertools
import random
import re
import zlib

import pytest

from mergetide.llm import queries, spelling


def near(words):
    """All ordered pairs one edit apart, by trying every edit that leads to another word."""
    words, holes, out = set(words), collections.defaultdict(list), set()
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].append(w)
    for (a, b), of in holes.items():
        out |= set(itertools.permutations(of, 2))
        if a + b in words:
            out |= {(w, a + b) for w in of} | {(a + b, w) for w in of}
    return out


def pairs(spark, words, **options):
    got = [tuple(r) for r in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string"), **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(300)}
    return sorted(words | {"a", "aa", "aaa", "aab", "ba", "abab", "baba", "ÿ", "ÿÿ"})


@pytest.mark.parametrize("most_levels", [64, 4, 1])
def test_near_words(spark, made, most_levels):
    """Also where most words, or all but one, go by their places instead of the trie."""
    want = near(made)
    assert len(want) > 500 and pairs(spark, made, most_levels=most_levels) == want


def test_long_words(spark):
    long = "ab" * 700
    words = [long, long[:-1], long[1:], long[:700] + "c" + long[701:], long[:700] + "d" + long[701:], "x" * 64, "x" * 65, "x" * 66, "x" * 63 + "y"]
    assert pairs(spark, words) == near(words) != set()


def test_variants(spark):
    counts = {"colour": 40, "color": 100, "colors": 20, "colours": 19, "kolors": 10, "kolor": 10, "house": 7, "mouse": 7, "hours": 14, "zzzzz": 3}
    rows = [*counts.items(), (None, 5), ("nulls", None)]
    df = spark.createDataFrame([(w, n, "x") for w, n in rows], "word string, n long, form string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()}
    assert got == {
        "color": (None, "color", 100, 3, None),
        "colour": ("color", "color", 40, 2, 100),
        "colors": ("color", "color", 20, 3, 100),
        "colours": ("colour", "color", 19, 2, 40),
        "kolors": ("colors", "color", 10, 2, 20),  # of equal ones the first in order
        "kolor": ("color", "color", 10, 2, 100),
        "house": (None, "house", 7, 1, None),
        "mouse": (None, "mouse", 7, 1, None),
        "hours": (None, "hours", 14, 0, None),
        "zzzzz": (None, "zzzzz", 3, 0, None),
    }
    assert spelling.variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(df, ratio=1)


def test_long_chains_have_one_root(spark):
    words = [("abcdefgh"[:i] + "x" * (8 - i), 3 ** (i + 1)) for i in range(9)]
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert set(got.values()) == {"abcdefgh"}


def test_words_of_documents(spark):
    texts = ["Aé Äpfel×apfel apfel's don't", None, "", "  ", "HOUSE house House " * 30, "1234 _x_ ÿÿ÷ÿ Ā ß", "x" * 5000, "house house"]
    rows = [(i % 7 if i else None, t, 3, "w") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, word string")
    want = collections.Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({65 + j: 97 + j for j in range(26)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = queries.noisy_words(docs)
    assert collections.Counter(r.word for r in words.collect()) == want
    kept = {r.word: r.n for r in spelling.count_words(words).collect()}
    assert kept == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3} != {}
