"""Readers on files made here, and the scan as a stream."""

from quire.operators import detectors
from quire.sources import readers
from quire.streaming import scan


def test_text_files_and_preferred_readmes(spark, tmp_path):
    for slug, name, text in (("a", "README.rst", "rst"), ("a", "README.md", "one\r\ntwo"), ("b", "readme.txt", "﻿x"), ("b", "notes.md", "no")):
        (tmp_path / slug).mkdir(exist_ok=True)
        (tmp_path / slug / name).write_bytes(text.encode())
    files = readers.text_files(spark, f"file://{tmp_path}/*/*")
    assert files.count() == 4
    got = {r["slug"]: (r["text"], r["crlf"]) for r in readers.preferred_readmes(files).collect()}
    assert got == {"a": ("one\ntwo", True), "b": ("x", False)}


def test_assistant_prose(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a b c d e"), (1, 1, "assistant", "one two ```code here``` three four"), (1, 2, "assistant", "short"), (1, 3, "assistant", None)], "conv_id long, turn long, role string, text string")
    assert [r["turn"] for r in readers.assistant_prose(turns).collect()] == [1]


def test_scan_as_a_stream_equals_the_batch_scan(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = readers_stream(spark, tmp_path, docs)
    scan.scan_to(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, scan.scan(docs).collect()))
    assert got.agg({"long_paragraphs": "sum"}).first()[0] == detectors.long_paragraphs(docs).count()


def readers_stream(spark, tmp_path, docs):
    return scan.read_landed(spark, f"file://{tmp_path}/in", docs.schema, 1)
