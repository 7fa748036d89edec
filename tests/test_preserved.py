"""The preservation gate on hand-made pairs."""

import pytest

from quire.operators import preserved

TEXT = (
    "---\na: b\n---\n# Head\n\nThe `x y` of https://a.b/c?utm_source=openai&d=1 in src/a.py, ![alt 7](pic), <img src=\"logo\" width=\"60\"> held 1,200 of it on 2024-05-06. He said \"these are four words\" &#8203;.\n"
    "```sh\n# no head 5\n```\n| t 9 |\n> q 8\n## Head\n## Head\n"
)
CASES = {
    "same": (TEXT, []), "reflowed": (TEXT.replace("The `x y`", "Now,  the `x y`").replace("1,200", "1200").replace("?utm_source=openai&d=1", "?d=1").replace("# Head\n\n", "# HEAD\n\n").replace("alt 7", "other 8"), []),
    "code": (TEXT.replace("no head", "my head"), [("code block", "```sh\n# no head 5\n```")]), "inline": (TEXT.replace("`x y`", "`x z`"), [("inline code", "`x y`")]), "front": (TEXT.replace("a: b", "a: c"), [("front matter", "---\na: b\n---\n")]),
    "link": (TEXT.replace("a.b/c", "a.b/e"), [("link", "https://a.b/c?d=1")]), "path": (TEXT.replace("src/a.py", "src/b.py"), [("path", "src/a.py")]), "image": (TEXT.replace("(pic)", "(pin)"), [("image source", "pic")]),
    "tag": (TEXT.replace('src="logo"', 'src="new"'), [("image source", "logo")]), "number": (TEXT.replace("1,200", "12"), [("number", "1200")]), "date": (TEXT.replace("2024-05-06", "2024-05-07"), [("date", "2024-05-06")]),
    "quote": (TEXT.replace("four words", "more words"), [("quotation", "these are four words")]), "table": (TEXT.replace("| t 9 |", "| t |"), [("table row", "| t 9 |")]), "quoted": (TEXT.replace("> q 8", "> q"), [("block quote", "> q 8")]),
    "heading": (TEXT.replace("## Head\n## Head", "## Head"), [("heading", "## head"), ("heading count", "3 -> 2")]), "dash": (TEXT + "so — and 2010–2012\n", [("dashes", "0 -> 1")]), "tell": (TEXT + "We delve in.\n", [("tells", "0 -> 1")]),
    "width": (TEXT.replace('width="60"', 'width="61"'), []),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, TEXT, new, 1) for name, (new, _) in CASES.items()] + [("null", None, TEXT, 1), ("gone", "a 5", None, 1), ("empty", "", "", 1)]
    pairs = spark.createDataFrame(rows, "id string, original string, rewritten string, kind int")
    return pairs, preserved.violations(pairs).collect()


@pytest.mark.parametrize("name", CASES)
def test_violations(found, name):
    assert sorted((r.kind, r.item.lstrip(" \n") if r.kind == "table row" else r.item) for r in found[1] if r.id == name) == CASES[name][1]


def test_verdicts(found):
    pairs, rows = found
    assert all(r.n == 1 and not r.allowed for r in rows)
    free = {r.id: (r.ok, r.hard, r.soft) for r in preserved.verdicts(pairs, structure=True, fact=True, dashes=True).collect()}
    assert free["heading"] == (True, 0, 2) and free["number"] == (True, 0, 1) and free["dash"] == (True, 0, 1) and free["code"] == (False, 1, 0)
    strict = {r.id: r.ok for r in preserved.verdicts(pairs).collect()}
    assert {i for i, ok in strict.items() if ok} == {"same", "reflowed", "width", "empty"} | ({"null"} if strict["null"] else set())
    assert len(strict) == len(CASES) + 3 and not strict["gone"] and preserved.verdicts(pairs.limit(0)).collect() == []
    added = [(r.kind, r.item) for r in preserved.changes(pairs).where("id = 'number' and added > 0").collect()]
    assert added == [("number", "12")]


def test_items_are_computed_once(spark):
    """No filter by the number of items below the generator, which would compute them again on each side."""
    pairs = spark.createDataFrame([(1, "a 5", "a 6"), (2, None, "")], "id long, original string, rewritten string")
    plan = preserved.changes(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("front matter") == 2 and [(r.id, r.kind, r.item) for r in preserved.violations(pairs).collect()] == [(1, "number", "5")]


def test_common_beginning_loses_nothing(spark):
    """Pairs of texts from pieces that reach over lines and sentences: what follows a common beginning gives the same as both texts whole."""
    import random

    from pyspark.sql import functions as F

    pieces = [
        "A plain word. ", "And so it is.\n", "Of it there. ", "we go on. ", "no end", "\n", "\n\n", " ", "# ", "#\n", "## Head\n", "| a. b |\n", "> said so. Or\n", "---\n", "```\n", "~~~\n", "`c. D` ", "`", '"', '"four words. Are here" ', "“", "” ",
        "May", " 3, ", "2024", " 5", " to ", "6 percent. ", "%", "1,200", " 7.5. ", "v1.2 ", "<b>", "<", "> ", "![a. B](", "x.png) ", "https://a.b/c. ", "http://x | a word. Next |\n", "src/a.b ", "&mdash; ", "—", "2010–2012", "it's not this, it's ", "Delve. In", "\r\n", "été. Un ",
    ]
    # A URL that is masked would make what follows a quote, were it the beginning.
    rng, rows = random.Random(4), [(0, "So it goes on. https://a.b/c. May 3", "So it goes on. https://a.b/c. > 1.2 6 percent.")]
    for i in range(1, 3000):
        start = [rng.choice(["", "", "---\na. B\n---\n"]), *(rng.choice(pieces[:5] if rng.random() < 0.6 else pieces) for _ in range(rng.randint(1, 12)))]
        ends = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) for _ in "ab"]
        rows.append((i, "".join(start) + ends[0], "".join(start) + ends[1]))
    pairs = spark.createDataFrame(rows, "id int, original string, rewritten string")
    parted = pairs.select(preserved._parted(F.col("original"), F.col("rewritten")).alias("t")).select("t.*").collect()
    assert all((r.head + r.a, r.head + r.b) == row[1:] for r, row in zip(parted, rows)) and 500 < sum(r.head != "" for r in parted) < 2900

    def kept(text):
        items, counts = (preserved._with_prose(F.col(text), f) for f in (lambda prose: preserved._items(F.col(text), prose), preserved._counts))
        rest, head = F.transform(items, lambda x: F.struct(x["kind"].alias("kind"), F.sort_array(x["items"]).alias("items"))), F.transform(counts, lambda x: x["n"])
        return F.struct(rest.alias("items"), head.alias("counts"))

    whole = {r.id: ({x.kind: x["items"] for x in r.a["items"]}, {x.kind: x["items"] for x in r.b["items"]}, r.a["counts"], r.b["counts"]) for r in pairs.select("id", kept("original").alias("a"), kept("rewritten").alias("b")).collect()}
    want = set()
    for i, (a, b, m, n) in whole.items():
        for kind in a:
            for item in {*a[kind], *b[kind]}:
                more = a[kind].count(item) - b[kind].count(item)
                want |= {(i, kind, item, max(more, 0), max(-more, 0))} if more else set()
        want |= {(i, kind, f"{x} -> {y}", 1, 0) for kind, x, y in zip(("dashes", "tells", "heading count"), m, n) if y > x or (kind == "heading count" and x != y)}
    found = [tuple(r) for r in preserved.changes(pairs).collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 3000


def test_pairs_stay_rows_of_their_own(spark):
    """No shuffle, and copies of an item by number."""
    many = " ".join(str(i % 50) for i in range(3000))
    pairs = spark.createDataFrame([(1, many, many.replace(" 7 ", " x ", 3)), (2, "5\u0000 5 6", "6 5 7")], "id long, original string, rewritten string")
    plan = [f(pairs)._jdf.queryExecution().executedPlan().toString() for f in (preserved.changes, preserved.violations, preserved.verdicts)]
    assert not any("Exchange" in p or "Join" in p for p in plan)
    assert sorted((r.id, r.kind, r.item, r.lost, r.added) for r in preserved.changes(pairs).collect()) == [(1, "number", "7", 3, 0), (2, "number", "5", 1, 0), (2, "number", "7", 0, 1)]
