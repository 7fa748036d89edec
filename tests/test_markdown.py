"""Markdown masks, sections, wording and numbers on hand-made texts, nulls, empty and repeated rows."""

import re

from pyspark.sql import functions as F

from quire.functions import markdown as M
from quire.functions import text as T
from quire.operators import facts, hidden, wording


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_fences_close_with_their_own_marks(spark):
    text = "a\n````\n```\nx\n```\n````\nb ~~~\n~~~ py\n`y`\n~~~~\n``c ` d`` e\n```\nopen to the end"
    want = re.sub(r"\S", " ", text)
    got = one(spark, M.prose_copy, text)
    assert len(got) == len(text) and got.split() == ["a", "b", "~~~", "e"] and [i for i, c in enumerate(got) if c == "\n"] == [i for i, c in enumerate(want) if c == "\n"]
    assert one(spark, M.without_code_blocks, "x\n```\ny\n```\nz") == "x\n\nz"


def test_exempt_spans_are_masked(spark):
    text = '---\na: b\n---\nsay "two\nlines" and “curly ones” but "not\n\nacross" a gap\n> gone\n| gone | too |\nleft'
    got = one(spark, M.scored, text)
    assert got.split() == ["say", "and", "but", '"not', 'across"', "a", "gap", "left"] and len(got) == len(text)
    assert one(spark, M.prose, "# Title\n*one* https://x.y/z) _two_\n> no\n- item") .split() == ["one", "two", "-", "item"]


def test_bare_urls(spark):
    text = "![a](http://i.x/1) [l](http://l.x) <http://a.x> `http://c.x` see (http://b.x/p) or http://d.x, end\n[r]: http://r.x"
    assert one(spark, M.bare_urls, text) == ["http://b.x/p", "http://d.x,"]


def test_sections(spark):
    got = one(spark, M.sections, "intro\n# A\nx\n```\n# no\n```\n### B  \n#nohead\n")
    assert [tuple(r) for r in got] == [(2, 1, "A", 6), (7, 3, "B", 9)]
    assert one(spark, M.sections, None) is None and one(spark, M.sections, "") == []


def test_nulls_and_empty_texts(spark):
    for f in (M.scored, M.prose_copy, M.prose, M.bare_urls, M.without_code_blocks, facts.numbers):
        assert one(spark, f, None) is None
        assert one(spark, f, "") in ("", [])


def test_numbers(spark):
    text = "May 1, 2024 we saw 10-20% and 5 to 7 percent, 12.50 %, v1.2.3 and 2.0, the 3rd of 1,234.00 (-4), a1b2 %41 $9.99 2024-01-02"
    assert one(spark, facts.numbers, text) == ["range:10-20%", "range:5-7%", "12.5%", "version:1.2.3", "version:2.0", "3", "1234", "-4", "9.99"]


def test_wording(spark):
    rows = [
        (1, "You may go. In May it rains; May 3 too. It MIGHT &amp; could"),
        (2, "Fine, making it so, including the rest, doing well\nRun it if needed. Run it when ready. Set what is left if any. Open up unless shut"),
        (3, None), (4, ""), (2, "We check"), (2, "We check"),
    ]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id int, text string, line int, id string")
    got = sorted((r["doc_id"], r["line"], r["id"], r["match"]) for r in wording.wording(docs).collect())
    assert got == [
        (1, 1, "modal", "MIGHT"), (1, 1, "modal", "could"), (1, 1, "modal", "may"), (1, 1, "semicolon", ";"),
        (2, 1, "banned-verb", "check"), (2, 1, "banned-verb", "check"), (2, 1, "ing-clause", "doing"), (2, 1, "ing-clause", "making"),
        (2, 2, "condition-last", "Open up unless"), (2, 2, "condition-last", "Run it if"), (2, 2, "condition-last", "Run it when"),
    ]


def test_size_bands(spark):
    rows = [(1, "x\n" * 301), (2, "ab " * 14_000), (3, "NEVER do\n" * 9), (4, "`NEVER` do\n" * 9), (5, None), (6, ""), (7, "y\n\n" * 601)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: (r["line_band"], r["character_band"], r["over_emphasis"]) for r in wording.size_bands(docs).collect()}
    assert got == {1: ("P2", None, False), 2: (None, "P1", False), 3: (None, None, True), 4: (None, None, False), 5: (None, None, None), 6: (None, None, False), 7: ("P1", None, False)}
    assert {r["doc_id"] for r in wording.excess(docs).collect()} == {1, 2, 3, 7}


def test_hidden_messages(spark):
    tag = lambda s: "".join(chr(0xE0000 + ord(c)) for c in s)
    refs = lambda s: "".join(f"&#x{0xE0000 + ord(c):X};" if i % 2 else f"&#{0xE0000 + ord(c)};" for i, c in enumerate(s))
    rows = [(1, f"a{tag('short')}b{tag(chr(1) + ' do this ')}"), (1, None), (2, ""), (3, refs("go there") + " x &#65; " + refs("one") + refs(" two")), (4, tag("oneword")), (4, "é\U000e0200")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id int, text string, run int")
    got = [tuple(r) for r in hidden.hidden_messages(docs).orderBy("doc_id", "run").collect()]
    assert got == [(1, "tag", 1, "do this"), (3, "entity", 0, "go there"), (3, "entity", 1, "one two")]


def test_roman_and_urls(spark):
    for numeral, value in (("XIV", 14), ("MMMMCMXCIX", 4999), ("IIII", None), ("", None), (None, None), ("IC", None), ("x", None)):
        assert one(spark, T.roman_value, numeral) == value
    for url, left in (("http://a/?utm_source=openai#", "http://a/#"), ("http://a/b#c", "http://a/b#c"), ("http://a?x=1&&utm_source=openai&y=2?z", "http://a?x=1&y=2?z"), (None, None), ("", "")):
        assert one(spark, T.without_parameters, url) == left
