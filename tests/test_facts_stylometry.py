"""Facts, and the cases that the tables lack: nulls, empty texts, ties, repeated rows, empty tables."""

import random
import re

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import corpus, detectors, facts, stylometry


def test_facts_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, 'See "too short" and "these are four words". On March 5, 2024 Anna Lee met Bob. The End')]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in docs.select("doc_id", facts.dates(F.col("text")).alias("d"), facts.quotes(F.col("text")).alias("q"), facts.names(F.col("text")).alias("n")).collect()}
    assert (got[1]["d"], got[1]["q"], got[1]["n"]) == (None, None, None) and (got[2]["d"], got[2]["q"], got[2]["n"]) == ([], [], [])
    assert got[3]["d"] == ["2024-03-05"] and got[3]["q"] == ["these are four words"] and got[3]["n"] == ["Anna Lee", "Bob"]  # "On March" begins a sentence


def test_lost_and_added_facts(spark):
    before = spark.createDataFrame([(1, "it was on 4 May 2021 that we met Carol King"), (2, "same")], "doc_id long, text string")
    after = spark.createDataFrame([(1, "it was on 2021-05-04 that we met Dora"), (2, "same")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in facts.lost_facts(before, after).collect()}
    assert got[1]["lost_dates"] == [] and got[1]["lost_names"] == ["Carol King", "May"] and got[1]["added_names"] == ["Dora"]
    assert not any(v for c, v in got[2].asDict().items() if c != "doc_id")
    assert facts.lost_facts(before.limit(0), after).count() == 0


def test_moving_ttr_equals_brute_force(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(n))) for i, n in enumerate((0, 4, 5, 6, 40, 200))] + [(9, None)]
    got = {x["doc_id"]: x["v"] for x in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", T.moving_ttr(F.split("text", " "), 5).alias("v")).collect()}
    for i, text in rows:
        w = (text or "").split(" ")
        want = sum(len(set(w[j : j + 5])) for j in range(len(w) - 4)) / (len(w) - 4) / 5 if text is not None and len(w) >= 5 else None
        assert got[i] == want or abs(got[i] - want) < 1e-12


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "x", 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, marker string, n int")


def test_repeated_rows_do_not_multiply(spark):
    rows = [(i, f"the cat and the dog of number {i}. It was so. We are here, but not there.", "w") for i in range(3)]
    once, twice = (stylometry.long_measures(docs_of(spark, rows * k)).count() for k in (1, 2))
    assert twice == 2 * once
    assert stylometry.voice_distance(docs_of(spark, rows * 2)).count() == 3


def test_every_document_meets_every_baseline(spark):
    rows = [(i, "the cat and the dog", "a") for i in range(3)] + [(i + 10, "no, we do not; they did", "b") for i in range(3)] + [(20, "xyz", "c"), (21, None, "a"), (22, "", "b")]
    got = stylometry.voice_distance(docs_of(spark, rows)).collect()
    assert len(got) == 14 and {r["baseline"] for r in got} == {"a", "b"}  # a writer with one document has no band
    assert {(r["source"], r["verdict"]) for r in got if r["baseline"] == "a" and r["source"] == "a"} == {("a", "in_range")}
    assert stylometry.voice_distance(docs_of(spark, [])).count() == 0


def test_documents_meet_baselines_as_one_row(spark):
    """No row is made and grouped for a document, marker and writer, and documents are not sorted by writer."""
    rows = [(i, "the cat and the dog", "a") for i in range(3)] + [(i, "no, we do not; they did", "b") for i in range(3)]
    for f, join in ((stylometry.voice_distance, "BroadcastNestedLoopJoin"), (stylometry.self_distance, "ShuffledHashJoin")):
        plan = f(docs_of(spark, rows))._jdf.queryExecution().executedPlan().toString()
        assert join in plan and not re.search(r"Aggregate\(keys=\[source#\d+, doc_id#\d+L?, ", plan)
    assert {(r.source, r.doc_id, r.delta) for r in stylometry.self_distance(docs_of(spark, rows)).collect()} == {(s, i, 0.0) for s in "ab" for i in range(3)}


def test_texts_that_share_an_id_count_together(spark):
    rows = [(1, "the cat the", "a"), (1, "a cat the", "a"), (1, "the", "a"), (2, "the", None), (None, "of it's", "a"), (3, "xyz", "a"), (4, "", "a"), (5, None, "a")]
    got = stylometry.marker_counts(docs_of(spark, rows)).collect()
    want = [("a", 1, 3, "the", 3), ("a", 1, 3, "a", 1), ("a", 1, 1, "the", 1), (None, 2, 1, "the", 1), ("a", None, 2, "of", 1), ("a", None, 2, "it's", 1)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {(r.source, r.doc_id): len(r.found) for r in stylometry._marked(docs_of(spark, rows)).collect()} == {("a", 1): 3, (None, 2): 1, ("a", None): 2, ("a", 3): 0}
    assert {(r.source, r.marker): r.docs for r in stylometry.marker_baseline(docs_of(spark, rows)).collect()} == {("a", m): 3 for m in ("the", "a", "of", "it's")}


def test_digests_of_null_texts_and_ties(spark):
    got = sorted(map(tuple, corpus.digest_dedup(docs_of(spark, [(1, None, "a"), (2, "t", "a"), (3, "t", "a"), (4, None, "a"), (2, "t", "b")])).select("doc_id", "first_id", "kept").collect()))
    assert got == [(1, 1, True), (2, 2, True), (2, 2, True), (3, 2, False), (4, 1, False)]


def test_hidden_comments(spark):
    html = "<!-- one two three four five six seven eight --><!-- one two --><!-- eslint-disable a b c d e f g h -->"
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (3, "")], "page_id long, html string")
    assert [(r["pos"], r["words"], r["unexplained"]) for r in detectors.concealed_spans(pages).orderBy("pos").collect()] == [(0, 8, True), (1, 2, False), (2, 9, False)]


def test_numbers_take_one_pass_a_kind(spark):
    """What one kind has claimed is replaced, not masked by width: no arrays of gaps are made."""
    texts = ["5 to 7% of\n3 percent, v1.2.3 and 4th", "%20 5 March 3, 2024 6", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").select("id", facts.numbers(F.col("text")).alias("n"))
    assert "split(" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.n for r in rows.collect()} == {0: ["range:5-7%", "3%", "version:1.2.3", "4"], 1: ["5", "6"], 2: [], 3: None}
