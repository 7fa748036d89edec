"""Bytes that are no UTF-8, very long runs, ids beyond the width and tables without ids."""

import time

import pytest

from quire.llm import chunk_store, line_crf, packing, quality_lm, secrets


@pytest.fixture
def broken(spark):
    rows = spark.sql("SELECT id AS doc_id, cast(concat(cast(concat('some words and a key = \"abcDEF123456xyz', id, '\"\n') AS binary), X'FF', cast(' more' AS binary)) AS string) AS text, 'en' AS lang FROM range(4)")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    return rows, labels


def test_invalid_bytes(spark, broken, tmp_path):
    docs, labels = broken
    assert packing.pack(docs).count() == 4
    assert {r.secret for r in secrets.scan_secrets(docs).collect()} <= {True, False}
    assert quality_lm.perplexities(docs, labels).count() == 4
    judged = line_crf.quality_rules(docs, labels).collect()
    assert len(judged) == 4 and all(r.n_words == 9 for r in judged)
    chunk_store.write_store(docs, f"file://{tmp_path}/store")
    assert {r.doc_id for r in chunk_store.read_documents(spark, f"file://{tmp_path}/store").collect()} == {0, 1, 2, 3}


def test_secret_candidates_of_long_runs_are_linear():
    began = time.time()
    assert secrets.candidates("key" * 350_000) == []
    assert secrets.candidates("keykey_token " * 80_000) == []
    assert time.time() - began < 2
    for text, want in (("my_api_key_value = 'abc!123$x'", "abc!123$x"), ("passwd: qwerty", "qwerty"), ("tokens = ab", None), ('"secret": "x1y2z3!"', "x1y2z3!"), ("monkey = banana1", "banana1")):
        assert [v for _, v in secrets.candidates(text)] == ([want] if want else [])


def test_ids_beyond_the_width_are_an_error(docs_of, tmp_path):
    with pytest.raises(Exception, match="does not fit in 2 bytes"):
        chunk_store.write_store(docs_of([(1, "a")]), f"file://{tmp_path}/wide", end_id=70_000)


def test_tables_without_ids(spark, docs_of):
    docs = docs_of([(None, f"text {i % 5} and so on") for i in range(300)])
    packed = packing.pack(docs, room=64).collect()
    assert len(packed) == 300 and len({(r.sequence_id, r.offset) for r in packed}) == 300
    sums = sorted((r.start, r.n_tokens) for r in chunk_store.store_and_sums(docs).collect())
    assert len(sums) == 300 and all(a + n == b for (a, n), (b, _) in zip(sums, sums[1:]))


def test_long_documents_give_the_field_a_bounded_number_of_lines(spark, docs_of, monkeypatch):
    monkeypatch.setattr(line_crf, "LINES", 10)
    docs = docs_of([(1, "a line of words\n" * 5000), (1, "another line\n" * 50), (2, "### $$$\n" * 3000)])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert line_crf.fit_field(docs.select("doc_id", "text"), labels) is not None
