"""The registered queries and the pipeline on the smallest tables: against DuckDB where SQL can say it, else plain Python."""

import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mergetide.llm import decontaminate, neardup, oracle, pii, queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture
def connection():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"create view {file.split('.')[0]} as select * from '{SF_DIR}/{file}'")
    return connection


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def ids_of(name, found, end):
    encoded = Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(list(found.values()), add_special_tokens=False)
    return {i: [*e.ids, *end] for i, e in zip(found, encoded, strict=True)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", oracle.SQL)
def test_against_duckdb(spark, connection, name):
    df, expected = queries.QUERIES[name](spark, SF_DIR), connection.sql(oracle.SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    order = [expected.columns.index(c) for c in df.columns]

    def key(row):
        return tuple((v is None, str(v)) for v in row)

    want = sorted((tuple(r[i] for i in order) for r in expected.fetchall()), key=key)
    assert sorted((tuple(r) for r in df.collect()), key=key) == want != []


def pieces_of(rows):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
        total = sum(n for _, n in parts)
        assert total <= 2048 and total & (total - 1) == 0
    return by_doc


def holds(by_doc, want):
    assert by_doc.keys() == want.keys()
    for i, ids in want.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, crc(ids[at : at + r.length]), len(ids))
            at += r.length
        assert at == len(ids)


def test_packing(spark):
    holds(pieces_of(queries.op1_packing(spark, SF_DIR).collect()), ids_of("word_bpe_49k.json", texts(spark), [1]))


def test_token_files(spark):
    want, at = [], 0
    for i, ids in sorted(ids_of("byte_bpe_50k.json", texts(spark), [2]).items()):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, queries.op4_token_files(spark, SF_DIR).collect())) == want


def test_token_counts(spark):
    found = texts(spark)
    want = {i: (len(found[i].encode()), len(ids), len(ids) > 512) for i, ids in ids_of("byte_bpe_50k.json", found, []).items()}
    assert {r.doc_id: tuple(r)[1:] for r in queries.op10_token_counts(spark, SF_DIR).collect()} == want


def test_pseudonyms_and_main_text_keep_every_row(spark):
    found = texts(spark)
    made = {r.doc_id: r for r in queries.op5_pseudonyms(spark, SF_DIR).collect()}
    assert made.keys() == found.keys()
    touched = {i for i, r in made.items() if sum(v for k, v in r.asDict().items() if k.startswith("n_")) > 0}
    assert touched and all((made[i].text or "") == found[i] for i in found.keys() - touched)
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    main = queries.op6_main_text(spark, SF_DIR).collect()
    assert sorted((r.page_id, r.url) for r in main) == sorted((r.page_id, r.url) for r in pages.collect())
    assert all(r.n_chars == len(r.text) for r in main) and sum(r.n_chars > 0 for r in main) > 0.8 * len(main)


def test_pipeline(spark, connection, tmp_path):
    """Which documents come out, by the SQL of the stages one after another; and their ids, by the library."""
    kept = connection.sql(oracle.SQL["op3_quality_rules"]).filter("kept").project("doc_id").fetchall()
    for name, good in (("op2_near_duplicates", "kept"), ("op7_decontamination", None)):
        ids = ",".join(str(i) for (i,) in kept)
        connection.execute(f"create or replace view documents as select * from '{SF_DIR}/documents.parquet' where doc_id in ({ids})")
        found = connection.sql(oracle.SQL[name])
        if good:
            kept = found.filter(good).project("doc_id").fetchall()
        else:
            bad = {i for (i,) in found.project("doc_id").fetchall()}
            kept = [(i,) for (i,) in kept if i not in bad]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where(F.col("doc_id").isin([i for (i,) in kept]))
    changed = pii.pseudonymise(docs, queries.pseudonym_key(spark), counts=False)
    assert changed.columns == docs.columns
    want = ids_of("word_bpe_49k.json", {r.doc_id: r.text or "" for r in changed.collect()}, [1])
    assert 50 < len(want) < 200
    holds(pieces_of(corpus_pipeline.run(spark, SF_DIR).collect()), want)


def test_stages_take_columns_of_any_name_and_type(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(1, f"{item} and more", 5, "a", "b", {"k": 1}), (2, "plain words here", 5, "a", "b", {"k": 2}), (2, "plain words here", 6, "a", "b", None)]
    rows += [(None, item, 7, "a", "b", {}), (None, "clean", 7, "a", "b", None)]
    schema = "doc_id long, text string, _kept_id int, _place_in_group string, _bad_id string, _bad_digest map<string,int>"
    df = spark.createDataFrame(rows, schema)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None", "None"]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = decontaminate.drop_contaminated(df, items)
    assert clean.columns == df.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["2", "2", "None"]
