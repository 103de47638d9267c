"""Each operator against plain Python on small tables with nulls, empty and long texts, repeated rows and clashing names."""

import base64
import collections
import hashlib
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from mergetide.llm import components, decontaminate, html_text, neardup, packing, pii, quality, secrets, token_counts, token_files, warc
from mergetide.llm.common import new_folder

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
WORDS = [f"w{i}" for i in range(400)]
ODD = [
    None, "", " ", "one", "  a  b\n\n c ", "x <|endoftext|>y. <|endoftext|>.z", "a b  c\td, it's. don't,", "H̱ W̊ E.F,g <|STARTOFTEXT|>",
    "tab\there 's\n't", "wörd's don't 12345! " * 3000, "same text here", "same text here", "éあ \U0001f600 ...,,. a.b",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_tokens long, kind string"


def words(start, n):
    return " ".join(WORDS[(start * 7 + i * (start + 3)) % 400] for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [*ODD, *[words(i, 120) for i in range(20)]]
    base = words(50, 200).split()
    texts += [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(10, 190, 9)] + [" ".join(base).upper()]
    rows = [(i, t, "en", f"s{i % 5}", 7, "x") for i, t in enumerate(texts)] + [(None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows + [rows[-2]], SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(path, texts):
    found = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [e.ids for e in found]


def test_token_counts(docs, empty):
    rows = docs.collect()
    got = token_counts.count_tokens(docs, BYTE, keep=("doc_id", "n_tokens")).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(i)) for r, i in zip(rows, ids_of(BYTE, [r.text for r in rows]), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(empty, BYTE).count() == 0


@pytest.mark.parametrize("n", [1, 1023, 1024, 5000])
@pytest.mark.parametrize("top", [0, 1, 50_000, 2**32 - 1])
def test_blocks_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, min(top, 300) + 1, n).astype(np.uint32)
    ids[:: max(1, n // 7)] = top
    blocks = token_files.pack_blocks(ids)
    data, starts = b"".join(blocks), np.cumsum([0, *map(len, blocks)])[:-1]
    assert (token_files.unpack_blocks(data, starts) == ids).all()


def test_token_files(spark, docs, empty):
    folder = new_folder(spark)
    manifest = token_files.write_tokens(docs, folder, BYTE, 2)
    got = token_files.read_tokens(spark, manifest, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i))
    rows = docs.collect()
    want = collections.Counter(
        (r.doc_id, np.array([*i, 2], "<u4").tobytes()) for r, i in zip(rows, ids_of(BYTE, [r.text for r in rows]), strict=True)
    )
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *[len(r.ids) // 4 for r in got]])[:-1].tolist()
    none = new_folder(spark)
    assert token_files.read_tokens(spark, token_files.write_tokens(empty, none, BYTE, 2), none).count() == 0


def test_packing(docs, empty):
    pieces = packing.pack(docs, WORD, 1, window=256, shard_ids=4000).collect()
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    twice = max(r.doc_id for r in rows)
    for r, ids in zip(rows, ids_of(WORD, [r.text for r in rows]), strict=True):
        if r.doc_id != twice:
            own = sorted(by[r.doc_id], key=lambda p: p.start)
            assert b"".join(bytes(p.ids) for p in own) == np.array([*ids, 1], "<u4").tobytes()
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
        total = sum(n for _, n in parts)
        assert total <= 256 and total & (total - 1) == 0
    assert packing.pack(empty, WORD, 1).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(docs, empty):
    rows = [r for r in docs.collect() if r.doc_id is not None]
    sets = {r.doc_id: shingles(r.text) for r in rows}
    parent = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                shared = len(sets[a] & sets[b])
                if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                    parent[a] = min(parent[a], parent[b])
    got = {r.doc_id: tuple(r) for r in neardup.near_duplicates(docs).collect()}
    assert got.pop(None) == (None, 1, None, True)
    assert got == {i: (i, len(s), parent[i], parent[i] == i) for i, s in sets.items()}
    assert len(set(parent.values())) < len(parent) - 15
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({v for v in parent.values()})


def test_blocks_settle_what_leaders_do_not(spark):
    """Two texts that are linked with one another, but not with the leader of their bucket."""
    base = words(1, 60).split()
    texts = {1: base, 2: base[:40] + [f"a{i}" for i in range(20)], 3: base[:40] + [f"a{i}" for i in range(19)] + ["z"]}
    named = spark.createDataFrame([(i, bytearray(" ".join(t).encode())) for i, t in texts.items()], "doc_id long, text binary")
    leading = spark.createDataFrame([(9, i, 3, 1) for i in texts], "key long, node long, n long, leader long")
    groups = spark.createDataFrame([], "node long, component long")
    assert [tuple(sorted(r)) for r in neardup._unsettled(leading, groups, named, 75).distinct().collect()][0] == (2, 3)


def test_texts_of_one_id_are_linked(spark):
    texts = {c: words(i * 11, 60) for i, c in enumerate("ABCDEFG")}
    rows = [(1, "B"), (9, "A"), (9, "B"), (2, "C"), (3, "D"), (4, "E"), (20, "C"), (20, "D"), (20, "E"), (7, "F"), (30, "F"), (30, " "), (31, "G"), (32, " "), (32, None)]
    df = spark.createDataFrame([(i, texts.get(t, t)) for i, t in rows], "doc_id long, text string")
    want = {1: 1, 9: 1, 2: 2, 3: 2, 4: 2, 20: 2, 7: 7, 30: 7, 31: 31, 32: 32}
    got = neardup.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == sorted((i, want[i], want[i] == i) for i, _ in rows)
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == [1, 2, 7, 31, 32]


def test_verification_tells_texts_of_one_id_apart():
    one, two = (" ".join(f"{c}{i}" for i in range(40)).encode() for c in "xy")
    batch = pa.RecordBatch.from_pydict({"a": [1, 2], "b": [9, 9], "text_a": [one, two], "text_b": [one, two]})
    assert [b.column("a").to_pylist() for b in neardup._verify(75)([batch])] == [[1, 2]]
    rows = {"group": [5] * 4, "side": [1] * 4, "node": [1, 1, 2, 3], "component": [1, 1, 2, 3], "text": [b" ", one, one, two]}
    blocks = list(neardup._compare_blocks(75)([pa.RecordBatch.from_pydict(rows)]))
    assert {tuple(sorted(x)) for b in blocks for x in zip(*b.to_pydict().values(), strict=True)} == {(1, 2)}


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (10, 11), (7, 7)], "a long, b long").repartition(5)
    assert sorted(map(tuple, components.connected_components(links).collect())) == [(3, 3), (4, 3), (5, 3), (9, 3), (10, 10), (11, 10)]


def test_quality_counts_and_risk(spark, docs, empty):
    n_good = 0
    for r in quality.with_features(docs, prefix="q_").collect():
        text = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = collections.Counter(grams)
        covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)}
        want = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]
        assert [r[f"q_{c}"] for c in quality.COUNTS] == want
        n_good += len(w) >= 50 and 100 * len(covered) <= 50 * len(w)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.quality_filter(empty, labels).count() == 0
    out = quality.quality_filter(docs, labels)
    assert out.columns == docs.columns and out.count() == n_good > 20  # one label certifies nothing


def test_binomial_tail(spark):
    from math import comb

    cases = [(k, n) for n in (1, 10, 300, 900) for k in (0, 1, 3, n // 2, n) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("p", quality.binomial_tail(F.col("k"), F.col("n"), 0.02))
    for r in df.collect():
        exact = sum(comb(r.n, j) * 0.02**j * 0.98 ** (r.n - j) for j in range(r.k + 1))
        assert r.p == pytest.approx(exact, rel=1e-9) or (r.p == 1 and r.k >= r.n * 0.02)


def test_decontamination(spark, docs, empty):
    item = words(78, 30)
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one"), (5, item)], "item_id long, text string")
    inside = spark.createDataFrame([(900, words(5, 300) + " " + item.upper() + " " + words(6, 300)), (901, words(8, 99))], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(inside)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(both, items).collect()}
    assert got == {(900, 1), (900, 5), (3, 4)}
    assert decontaminate.drop_contaminated(both, items).count() == both.count() - 2
    assert decontaminate.contained_items(empty, items).count() == 0


def test_decontamination_judges_rows_without_id_alone(spark):
    item = words(78, 30)
    halves = [" ".join(item.split()[:16]), " ".join(item.split()[14:])]
    rows = [(None, f"{words(5, 99)} {item}"), (None, words(8, 99)), (None, None), (None, halves[0]), (None, halves[1]), (1, words(6, 99)), (2, item), (2, "clean")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.drop_contaminated(df, items)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted(rows[1:6], key=str)


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms(spark, empty):
    texts = ["card 4111111111111111, 4111 1111 1111 1111 and 4111111111111112", "mail Jo.Doe7@x.example.com on 1984-02-29 or 2/29/1984", "ip 10.1.2.3 999.1.1.1 +1 (743) 555-3824", None, "", "no data"]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, pii_m string")
    out = {r.doc_id: r for r in pii.pseudonymise(df, "key").collect()}
    first, spaced, invalid = re.search(r"card (\d{16}), ([\d ]{19}) and (\d{16})", out[0].text).groups()
    assert luhn(first) and first == spaced.replace(" ", "") != "4111111111111111" and invalid == "4111111111111112"
    assert re.fullmatch(r"mail [A-Z][a-z]\.[A-Z][a-z]{2}\d@x\.example\.com on \d{4}-\d\d-\d\d or \d\d?/\d\d?/\d{4}", out[1].text)
    assert "999.1.1.1" in out[2].text and "10.1.2.3" not in out[2].text and "555-3824" not in out[2].text
    assert [out[i].text for i in (3, 4, 5)] == texts[3:] and out[1].pii_m == "n"
    assert (out[0].n_card, out[1].n_date, out[2].n_phone) == (2, 2, 1)
    assert pii.pseudonymise(empty, "key", counts=False).columns == empty.columns


def test_permutation_is_one_to_one(spark):
    df = spark.range(12).crossJoin(spark.range(7).withColumnRenamed("id", "b"))
    made = df.select(pii.permute(F.col("id"), F.col("b"), F.lit(12), F.lit(7), "k", F.lit("x")).alias("p")).select("p.*").collect()
    assert len({tuple(r) for r in made}) == 84 and all(0 <= r.a < 12 and 0 <= r.b < 7 for r in made)


def test_secrets(spark, empty):
    live, copied = "aB3dE5gH7jK9mN1pQ3sT", "deadbeef01234567deadbeef"
    texts = [f'é token = "{live}" x', f"bare {live}!", *[f"password: {copied}" for _ in range(6)], "token = secret = abcdefghijkl1", "AKIA" + "A1" * 8, None, ""]
    df = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.spans for r in secrets.find_secrets(df).collect()}
    assign = re.compile(secrets.ASSIGN)
    for i, t in enumerate(texts):
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t or "") if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 16]
        assert [(s.start, s.kind, s.end) for s in got[i] if s.kind < 3] == sorted(want)
    assert got[0][0].live and [s.kind for s in got[1]] == [3] and not got[2][0].live
    assert secrets.find_secrets(empty).count() == 0


def test_archives(spark):
    rows = [(3, "http://B.a/x y\n", "dup"), (1, "http://b.a/", "dup"), (2, None, None), (4, "u", ""), (None, "v", "dup"), (1, "http://b.a/", "dup"), (5, "http://c/", "ü" * 9999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write_archives(pages)
    first = {"dup": 1, "": 2, rows[-1][2]: 5}
    want = []
    for i, u, h in rows:
        data = (h or "").encode()
        again = i != first[h or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, u, len(data), digest, "revisit" if again else "response", first[h or ""] if again else None, None if again else data))
    got = [(*tuple(r)[:6], None if r.payload is None else bytes(r.payload)) for r in warc.read_archives(archive).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    lookup = warc.Lookup(archive)
    assert [f["WARC-Record-ID"] for f, _ in lookup.captures("http://b.a/")] == ["<urn:page:1>"] * 2
    assert list(lookup.captures("http://nowhere/")) == []
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_main_text():
    pages = [
        f"<html><head><title>t</title></head><body><nav><ul><li><a href='#'>{words(i, 2)}</a></li></ul></nav><div class='ad'>{words(i, 6)}.</div>"
        f"<article><h1>{words(i, 4)}</h1><p>{words(i + 1, 40)}. And &amp; more.</p><p><b>{words(i, 9)}.<br><p>{words(i + 2, 5)}.</p></article>"
        f"<footer>&copy; {words(i, 3)}</footer></body></html>"
        for i in range(60)
    ]
    model = html_text.fit(pages[:40])
    for i in range(40, 60):
        want = [words(i, 4), f"{words(i + 1, 40)}. And & more.", f"{words(i, 9)}.", f"{words(i + 2, 5)}."]
        assert html_text.main_text(pages[i], model).split("\n") == want
    assert html_text.main_text("", model) == "" and html_text.main_text("<p" * 50, model) is not None


def test_main_text_is_fitted_on_different_pages_of_any_length(spark, monkeypatch):
    made = [f"<body><nav>{words(i, 3)}</nav><article><p>{words(i, 30 + 20_000 * (i % 3 == 0))}.</p></article></body>" for i in range(12)]
    assert max(map(len, made)) > 40_000
    pages = spark.createDataFrame([(i, h) for i, h in enumerate(made * 30 + [None, ""])], "page_id long, html string")
    seen, fit = [], html_text.fit
    monkeypatch.setattr(html_text, "fit", lambda given: seen.append(given) or fit(given))
    html_text.extract(pages, keep=("page_id",), sample=10)
    html_text.extract(pages, keep=("page_id",))
    html_text.extract(pages.where("length(html) > 40000"), keep=("page_id",))
    assert [len(s) for s in seen] == [len(set(s)) for s in seen] == [10, 12, 4]
    assert set(seen[1]) == set(made)
    assert [len(html_text.sampled(pages, most=m)) for m in (1, 3 * min(map(len, made)))] == [1, 2]
    blank = html_text.extract(pages.where("coalesce(html, '') = ''"), keep=("page_id",)).collect()
    assert [r.text for r in blank] == ["", ""] and len(seen) == 3


@pytest.mark.parametrize("n", [3, 49, 50, 190])
def test_siblings_are_told_by_place_and_tag_at_any_number(n):
    nodes, _, _ = html_text.parse("<article>" + "<p>one.</p>" * n + "<div>two</div></article>")
    x = html_text.features(nodes)
    last = [i for i, node in enumerate(nodes) if node.tag == "div"][0]
    below = nodes[nodes[last].parent].children
    assert x[below, -2] == pytest.approx([k / (n + 1) for k in range(n + 1)])
    assert x[below, -5] == pytest.approx([n / (n + 1)] * n + [1 / (n + 1)])


@pytest.mark.parametrize("unit", ["<p", "a <b c ", '<a "', "<a '\" ", '<p "x', "<p<p ", "</i><b>", "<x>", "<body>", "\"<p>'"])
def test_pages_are_parsed_in_linear_time(unit):
    """A megabyte of broken markup, with and without a tag's end far behind it."""
    for end in ("", '>"', "</p>"):
        page = unit * (1_000_000 // len(unit)) + end
        began = time.perf_counter()
        html_text.parse(page)
        assert time.perf_counter() - began < 15
    assert html_text.parse('x <b c="1>2" d=\'>\'/>y</b> < z <!-- <p> --><q')[1] == ["x y < z <q"]


def test_registry():
    names = entry.queries()
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in names)] == [] and "pipeline" in names
