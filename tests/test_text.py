"""Text functions on hand-made rows."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import corpus, joins, stats


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_words_and_sentences(spark):
    assert one(spark, "Don't stop. It's well-known!", T.words) == ["don't", "stop", "it's", "well-known"]
    assert one(spark, "One two. Three!\nFour", T.sentences) == ["One two.", "Three!", "Four"]
    assert one(spark, "", T.words) == []
    assert one(spark, None, T.words) is None


def test_ngrams_and_mattr(spark):
    assert one(spark, "a b c", lambda c: T.ngrams(T.words(c), 2)) == ["a b", "b c"]
    assert one(spark, "a", lambda c: T.ngrams(T.words(c), 2)) == []
    assert one(spark, "a b a b", lambda c: T.moving_ttr(T.words(c), 2)) == 1.0
    assert one(spark, "a a b b", lambda c: T.moving_ttr(T.words(c), 2)) == (1 + 2 + 1) / 6


def test_syllables(spark):
    for word, n in (("make", 1), ("table", 2), ("tree", 1), ("a", 1), ("readability", 5)):
        assert one(spark, word, T.syllables) == n


def test_canonical_number(spark):
    for raw, want in (("1,234", "1234"), ("2.50", "2.5"), ("3.0", "3"), ("x", "x")):
        assert one(spark, raw, T.canonical_number) == want


def test_html_text(spark):
    markup = "<html><script>var a='<p>';</script><p>One &amp; two<br>three</p><!-- no --><div> </div><b>four</b></html>"
    assert one(spark, markup, T.html_text) == "One & two\nthree\nfour"


def test_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, "", "s", "en"), (2, None, "s", "en"), (3, "One two three. Four.", "s", "en")], "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r for r in stats.document_stats(docs).collect()}
    assert got[1]["word_count"] == 0 and got[1]["ttr"] is None and got[3]["sentence_count"] == 2
    assert corpus.digest_dedup(docs).count() == 3  # a null text stays, as in SQL


def test_multiset_difference(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "k int, item string")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, item string")
    assert sorted(map(tuple, joins.multiset_difference(a, b, "k", "item").collect())) == [(1, "x", 1), (1, "y", 1)]


def test_nearest_skips_nulls_and_breaks_ties_by_id(spark):
    v = spark.createDataFrame([(20, [0.0]), (1, [1.0]), (2, [-1.0]), (3, None), (None, [0.0]), (5, [9.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["other_id"]) for r in joins.nearest(v, k=2).orderBy("rank").collect()] == [(20, 1), (20, 2)]


def test_counts_of_findings_are_computed_once(spark):
    """Sentences are cut once for each text: no filter below the generator computes them again."""
    from quire.operators import detectors

    docs = spark.createDataFrame([(1, "A b. " * 8 + "\nC d."), (2, None), (3, ""), (4, "w " * 30 + ". " + "w " * 31 + ".")], "doc_id long, text string")
    assert [tuple(r) for r in detectors.long_paragraphs(docs).collect()] == [(1, 0, 8)]
    assert [(r.doc_id, r.pos, r.n) for r in detectors.long_sentences(docs, allowance=0).collect()] == [(4, 0, 30), (4, 1, 31)]
    for found in (detectors.long_paragraphs(docs), detectors.long_sentences(docs)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("approx") == 1
