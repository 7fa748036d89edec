"""Sentences, forms, catalogue scans, edits and rewrite units on hand-made texts, nulls, empty and repeated rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import inflect
from quire.functions import text as T
from quire.operators import edits, lexicon, units
from quire.operators.units import blocks_of, is_prose, sentences_of

SENTENCES = {
    'Dr. Who met Mr. No. 5 in the U.S. today. Then he said "yes." (Fine!) Next': ["Dr. Who met Mr. No. 5 in the U.S. today.", 'Then he said "yes."', "(Fine!)", "Next"],
    "Buy:\n- milk\n- eggs\n  1. one\n2) two\n* x": ["Buy:", "- milk", "- eggs", "1. one", "2) two", "* x"],
    "one etc. two? three!\n\nfour…": ["one etc. two?", "three!", "four…"],
    "éDr. x": ["éDr.", "x"],
    "": [], "  \n": [], "a\x01b. c\x02d": ["ab.", "cd"],
}


def test_sentences(spark):
    rows = spark.createDataFrame(list(enumerate(SENTENCES)), "i int, t string")
    got = {r.t: r.s for r in rows.select("t", T.sentences(F.col("t")).alias("s")).collect()}
    assert got == SENTENCES
    for text, want in SENTENCES.items():
        if "\x01" not in text:
            assert [text[a:b] for a, b in sentences_of(text)] == want
    assert spark.sql("SELECT cast(NULL AS string) AS t").select(T.sentences(F.col("t")).alias("s")).first().s is None


def test_forms(spark):
    rows = spark.createDataFrame([("synergy",), ("day",), ("box",), ("agree",), ("use",), ("circle back",), ("",), (None,), ("  y ",)], "t string")
    got = {r.t: r.f for r in rows.select("t", inflect.forms(F.col("t")).alias("f")).collect()}
    assert got["synergy"] == ["synergy", "synergies", "synergied", "synergying"]
    assert got["day"] == ["day", "days", "dayed", "daying"] and got["box"] == ["box", "boxes", "boxed", "boxing"]
    assert got["agree"] == ["agree", "agrees", "agreed", "agreeing"] and got["use"] == ["use", "uses", "used", "using"]
    assert got["circle back"] == ["circle back", "circles back", "circled back", "circling back", "circle backs", "circle backed", "circle backing"]
    assert got[""] == [] and got[None] is None and got["  y "] == ["y", "ys", "yed", "ying"]
    nouns = {"movies": "movie", "cities": "city", "ties": "tie", "boxes": "box", "classes": "class", "status": "status", "statuses": "status", "cats": "cat", "glass": "glass", "People": "people"}
    found = spark.createDataFrame([(n,) for n in nouns], "n string").select("n", inflect.singular(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in found} == nouns


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [
        ("leverage", "leverage", "t1", "P1", 1), ("leverage", "Leverage The", "t1", "P1", 1), ("edge", "edge", "t1", "P2", 0), ("cut", "cutting-edge", "t1", "P1", None), ("game", "a game changer", "t2", "P1", 0),
        ("changer", "game changer", "t2", "P0", 0), ("game", "a game changer", "t2", "P1", 0), (None, "nothing", "t2", "P1", 0), ("none", None, "t2", "P1", 0), ("sign", "!!", "t3", "P1", 0),
    ]
    return spark.createDataFrame([(*r, "extra") for r in rows], "id string, term string, band string, priority string, max_allowed int, doc_id string")


def test_scan(spark, catalogue):
    rows = [
        (1, "LEVERAGE the edge, leverage  the\nedge: cutting-edge leverages. Leverage", "en"), (2, "It is a game\tchanger! a game, changer game changer !!", "de"), (3, None, "en"), (4, "", None), (5, "the edge", "en"), (5, "the edge", "en"),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, term int")
    skips = spark.createDataFrame([("de", "changer"), ("xx", "edge")], "register string, id string")
    want = sorted([
        (1, "leverage", 0, 2, False), (1, "edge", 2, 3, True), (1, "leverage", 4, 6, True), (1, "edge", 6, 7, True), (1, "cut", 8, 9, True), (1, "leverage", 11, 12, True),
        (2, "game", 2, 5, True), (2, "sign", 12, 13, True), (5, "edge", 1, 2, True), (5, "edge", 1, 2, True),
    ])
    for bounds in ({}, {"terms": 0}):
        got = sorted((r.doc_id, r.id, r.pos, r.end, r.past) for r in lexicon.scan(docs, catalogue, skips, "lang", **bounds).collect())
        assert got == want
    evidence = {r.term: (r.docs, r.hits) for r in lexicon.term_evidence(docs, catalogue).collect()}
    assert evidence["edge"] == (3, 4) and evidence["cutting-edge"] == (1, 1) and evidence["leverage"] == (1, 3) and evidence["game changer"] == (1, 2)
    assert lexicon.scan(docs.limit(0), catalogue).collect() == [] and lexicon.scan(docs, catalogue.limit(0)).collect() == []


def test_scan_by_trie_equals_the_join(spark):
    rng = random.Random(8)
    words = ["a", "b", "é", "c'd", "-", ","]
    terms = [(f"i{i}", " ".join(rng.choices(words[:4], k=rng.randint(1, 4))), f"b{i % 2}", "P1", i % 3) for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=30)), "x") for i in range(30)], "doc_id long, text string, lang string")
    table = spark.createDataFrame(terms, "id string, term string, band string, priority string, max_allowed int")
    both = [sorted(map(tuple, lexicon.scan(docs, table, **b).collect())) for b in ({}, {"terms": 1})]
    assert both[0] == both[1] and len(both[0]) > 100


def test_owned_terms(spark):
    rules = spark.createDataFrame([("c", "Foo", 0), ("p", "foo", 1), ("q", "bar", 1), ("r", "BAR", 1), ("n", None, 0)], "id string, term string, origin int")
    assert sorted((r.id, r.term) for r in lexicon.attributed(rules).collect()) == [("c", "Foo"), ("q", "bar")]


def edited(spark, texts, pairs):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, row int, edits string")
    table = spark.createDataFrame(pairs, "term string, replacement string")
    return sorted(edits.edit(docs, table).collect(), key=lambda r: r.doc_id)


def test_edits(spark):
    zero, nbsp = chr(0x200B), chr(0xA0)
    texts = [
        f"We Leverage{zero} it, leveraging `leverage` and \"leverage\" in re-leverage.\n# leverage\n> leverage\nhttps://x.y/leverage?a=1&utm_source=openai#f a/leverage.md set\nup {chr(0x1F468)}{chr(0x200D)}{chr(0x1F4BB)} x{chr(0x200D)}y -- z",
        f"a{nbsp}b{nbsp}c{nbsp}d", nbsp.join("abcde"), f"```\nx{zero}\n```", None, "", f"lever{zero}age leverage",
    ]
    got = edited(spark, texts, [("leverage", "use"), ("set up", "arrange"), ("arrange", "cut it"), (None, "x"), ("use", None)])
    assert got[0].text == (
        f"We Use it, using `leverage` and \"leverage\" in re-leverage.\n# leverage\n> leverage\nhttps://x.y/leverage?a=1#f a/leverage.md arrange {chr(0x1F468)}{chr(0x200D)}{chr(0x1F4BB)} xy -- z"
    )
    assert [(e.id, e.before, e.after) for e in got[0].edits][:3] == [("voice-substitution", "Leverage", "Use"), ("hidden-unicode", "U+200B", ""), ("voice-substitution", "leveraging", "using")]
    assert [s.id for s in got[0].skipped] == ["double-hyphen-dash"]
    assert got[1].text == texts[1] and got[2].text == "a b c d e" and got[3].text == texts[3] and [s.note for s in got[3].skipped] == ["in a protected span"]
    assert got[4].text is None and got[5].text == "" and got[4].edits == [] and set(got[0].asDict()) == {"doc_id", "row", "text", "edits", "skipped"}
    assert got[6].text == "leverage use"
    again = edited(spark, [r.text for r in got], [("leverage", "use"), ("set up", "arrange")])
    assert [r.text for r in again][:6] == [r.text for r in got][:6] and all(not r.edits for r in again[:6])


def test_edits_never_overlap_nor_touch_protected_spans():
    rng = random.Random(9)
    parts = ["leverage ", "`leverage` ", '"leverage it" ', "re", "\n", "> leverage\n", "| leverage |\n", chr(0x200B), chr(0xA0), "http://a.b/leverage?utm_source=openai ", "set\n", "up ", "# leverage up\n", "```\n"]
    by_term = {"leverage": "use", "set up": "do", "up": "on"}
    words = edits._word_pattern(by_term)
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        kept, _ = edits.planned(text, words, by_term)
        assert all(a[2] <= b[1] for a, b in zip(kept, kept[1:]))
        spans = [m.span() for p in edits._QUOTED for m in p.finditer(text)]
        assert not any(s < e[2] and e[1] < t for e in kept for s, t in spans)
        out, at = [], 0
        for _, s, e, _, new, _ in kept:
            out += [text[at:s], new]
            at = e
        assert edits._applied(text, kept) == "".join(out) + text[at:]


def test_splice(spark):
    texts = spark.createDataFrame([(1, "abcdef", "x"), (2, None, "y"), (3, "zz", "z")], "doc_id long, text string, changes string")
    rows = [(1, 0, 2, "A", True), (1, 1, 3, "lost", True), (1, 4, 6, "", True), (1, 3, 3, "+", True), (1, 2, 3, "no", False), (2, 0, 1, "q", True), (9, 0, 1, "q", True), (3, None, 1, "q", True)]
    changes = spark.createDataFrame(rows, "doc_id long, start int, end int, after string, accepted boolean")
    assert sorted(map(tuple, edits.splice(texts, changes, ["doc_id"]).collect()), key=repr) == [(1, "alost+d", "x"), (2, None, "y"), (3, "zz", "z")]


def test_blocks():
    text = "one\ntwo\n \t\n\n  \n# head\n\n- a\n- b\n\nlead:\n- x\n\n    code"
    found = [text[a:b] for a, b in blocks_of(text)]
    assert found == ["one\ntwo", "\n  \n# head", "- a\n- b", "lead:\n- x", "    code"] or [f.strip() for f in found] == ["one\ntwo", "# head", "- a\n- b", "lead:\n- x", "code"]
    assert [is_prose(f) for f in ("one\ntwo", "# head", "- a\n- b", "lead:\n- x", "lead:\nmore\n- x", "    code", "> q", "| t |", "", "1. x\ny")] == [True, False, False, False, True, False, False, False, False, False]


def test_units(spark):
    text = "First one. The odd one here.\nLast.\n\n- item odd\n\nThe odd one again. END"
    docs = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "", 5)], "doc_id long, text string, line int")
    rows = [
        (1, "w", "clarity", 1, "odd"), (1, "v", "clarity", 1, "ODD ONE"), (1, "w", "clarity", 4, "odd"), (1, "w", "clarity", 9, "odd"), (1, "w", "clarity", None, "gone"), (1, "tier2-cluster", "x", 6, "a, b"), (1, "tier3-density", "x", 3, None),
        (1, "tier2-cluster", "x", 99, None), (1, "low-diversity", "x", None, None), (1, "hidden-unicode", "x", 1, "odd"), (1, "q", "safety", 1, "odd"), (2, "w", "clarity", 1, "odd"), (7, "w", "clarity", 1, "odd"), (1, "w", "clarity", 1, "odd"),
    ]
    findings = spark.createDataFrame(rows, "doc_id long, id string, band string, line int, match string")
    found, rest = units.plan(docs, findings)
    assert sorted((r.kind, r.text, r.before, tuple(r.ids)) for r in found.collect()) == [("block", "The odd one again. END", "", ("tier2-cluster",)), ("span", "The odd one here.", "First one.", ("v", "w", "w"))]
    assert sorted((r.doc_id, r.id, r.reason) for r in rest.collect()) == [
        (1, "low-diversity", "of the whole document"), (1, "tier2-cluster", "not in the text"), (1, "tier3-density", "in no block"), (1, "w", "in a list, table, heading or code block"), (1, "w", "not in the text"), (2, "w", "not in the text"),
    ]
    assert units.plan(docs, findings.limit(0))[0].collect() == [] and units.plan(docs.limit(0), findings)[0].collect() == []


def test_asof(spark):
    rng = random.Random(3)
    spans = [(rng.randrange(3), rng.randrange(50), i) for i in range(60)]
    points = [(rng.randrange(4), rng.randrange(60), i) for i in range(80)]
    got = units.asof(spark.createDataFrame(points, "t int, start int, n int"), spark.createDataFrame(spans, "t int, start int, m int"), ["t"])
    for r in got.collect():
        want = max(((s, m) for t, s, m in spans if t == r.t and s <= r.start), default=None)
        assert (tuple(r.span) if r.span else None) == want
    assert re.match("span", got.columns[-1])


def test_python_holds_a_few_rows_of_a_batch():
    import pyarrow as pa

    from quire.operators.rounds import pieces

    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], ["a"])
    found = list(pieces([batch, batch.slice(0, 0), batch.slice(5, 3)]))
    assert max(b.num_rows for b in found) == 128 and [x for b in found for x in b.column(0).to_pylist()] == [*range(10_000), 5, 6, 7]
