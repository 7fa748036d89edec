"""Components, families, carried reviews, inheritance and blends against brute force and hand-made rows."""

import random

import pytest

from quire.operators import families, profiles


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (None, 3), (8, None)]
    got = {r.node: r.root for r in families.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    parent = {n: n for e in edges if None not in e for n in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if None not in (a, b):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {n: find(n) for n in parent}
    assert families.components(spark.createDataFrame([], "a int, b int")).collect() == []


@pytest.fixture(scope="module")
def members(spark):
    lifts = spark.createDataFrame([("carries", 5), ("carried", 9), ("carrying", 9), ("box", 3), ("boxes", 3), ("lone", 1), ("carries", 2), (None, 9)], "word string, lift int")
    return families.families(lifts, spark.createDataFrame([("carry", 1), ("box", 1), ("box", 1), (None, 1)], "word string, stem int")).cache()


def test_families(members):
    assert {r.word: r.stem for r in members.collect()} == {"carries": "carried", "carried": "carried", "carrying": "carried", "box": "box", "boxes": "box", "lone": "lone"}


def test_evidence(spark, members):
    docs = spark.createDataFrame([(1, "Carried boxes. carries a box\n\nbox it"), (2, None), (3, ""), (4, "carrying carried"), (4, "carrying carried")], "doc_id int, text string")
    assert {r.stem: (r.forms, r.docs, r.hits) for r in families.evidence(docs, members).collect()} == {"carried": (3, 3, 6), "box": (2, 1, 3), "lone": (1, 0, 0)}
    known = spark.createDataFrame([("it",), ("a",), ("a",)], "word string")
    assert {r.stem: r.paragraphs for r in families.tipped(docs, members, known).collect()} == {"carried": 3, "box": 2}


def test_carried(spark):
    found = spark.createDataFrame([("a", 5, "x"), ("b", 4, "x")], "stem string, lift int, status string")
    old = spark.createDataFrame([("b", 1, "accepted", "n"), ("c", 2, "rejected", None), ("d", 3, "pending", None), ("e", 3, None, None)], "stem string, lift int, status string, note string")
    assert sorted(map(tuple, families.carried(found, old).collect())) == [("a", 5, "pending", None, False), ("b", 4, "accepted", "n", False), ("c", 2, "rejected", None, True)]
    a, b = (spark.createDataFrame(r, "key string, value double") for r in ([("x", 1.0), ("y", None), ("z", 2.0)], [("x", 1.0), ("z", 3.0), ("w", None)]))
    assert [tuple(r) for r in families.drift(a, b).collect()] == [("z", 2.0, 3.0)]


RULES = [
    ("base", "banned", "synergy", "Synergy", 1), ("base", "banned", "deep", "deep", 2), ("base", "caps", "words", "30", 1), ("mid", "banned", "new", "new", 1), ("mid", "caps", "words", "20", 1), ("top", "banned", "synergy", "SYNERGY+", 1),
    ("top", "banned", "synergy", "SYNERGY++", 2), ("top", None, "x", "x", 1), ("top", "pairs", None, "x", 1), ("alone", "banned", "new", "n", 1), (None, "banned", "q", "q", 1),
]


def test_inheritance(spark):
    rules = spark.createDataFrame([(*r, 0) for r in RULES], "profile string, kind string, key string, value string, ord int, hop int")
    parents = spark.createDataFrame([("top", "mid"), ("mid", "base"), ("alone", None)], "profile string, parent string")
    got = {(r.profile, r.kind): [] for r in profiles.inherited(rules, parents).collect()}
    for r in profiles.inherited(rules, parents).orderBy("place").collect():
        got[r.profile, r.kind].append((r.key, r.value, r.origin))
    assert got["top", "banned"] == [("synergy", "SYNERGY++", "top"), ("deep", "deep", "base"), ("new", "new", "mid")]
    assert got["mid", "banned"] == [("synergy", "Synergy", "base"), ("deep", "deep", "base"), ("new", "new", "mid")]
    assert got["top", "caps"] == [("words", "20", "mid")] and got["alone", "banned"] == [("new", "n", "alone")] and len(got) == 7
    with pytest.raises(ValueError, match="loop"):
        profiles.inherited(rules, spark.createDataFrame([("top", "mid"), ("mid", "top")], "profile string, parent string"))
    docs = spark.createDataFrame([(1, "Synergy new synergy", "top"), (2, "new deep", "alone"), (3, None, "top"), (4, "deep", None)], "doc_id int, text string, voice string")
    hits = profiles.ban_hits(docs, profiles.inherited(rules, parents), "voice").collect()
    assert sorted(map(tuple, hits)) == [(1, "new", "mid", 1), (1, "synergy", "top", 2), (2, "new", "alone", 1)]


def test_pairs_have_one_spelling(spark):
    rows = spark.createDataFrame([('{"b":"1","a":"2"}',), ('{ "a": "2", "b": "1" }',), ("plain",), (None,)], "j string")
    assert [r[0] for r in rows.select(profiles.canonical(rows.j)).collect()] == ['{"a":"2","b":"1"}', '{"a":"2","b":"1"}', "plain", None]


def test_blend(spark):
    left = {"em_dash": "allow", "semicolon": "forbid", "max_sentence_words": "30", "oxford_comma": "allow", "date_format": "dmy", "tone": "dry", "only": "l", "emoji": "odd", "max_paragraph_sentences": "many"}
    right = {"em_dash": "limit", "semicolon": "allow", "max_sentence_words": "9.5", "oxford_comma": "require", "date_format": "mdy", "tone": "warm", "emoji": "allow", "max_paragraph_sentences": "4"}
    rows = [("l", k, v) for k, v in left.items()] + [("r", k, v) for k, v in right.items()] + [("z", "em_dash", "forbid")]
    table = spark.createDataFrame(rows, "profile string, key string, value string")
    got = {r.key: (r.value, r.conflict) for r in profiles.blended(table, "l", "r").collect()}
    assert got == {
        "em_dash": ("limit", False), "semicolon": ("forbid", False), "max_sentence_words": ("9.5", False), "oxford_comma": ("require", False), "date_format": ("dmy", True), "tone": ("dry", True), "only": ("l", False),
        "emoji": ("allow", False), "max_paragraph_sentences": ("many", False),
    }
    assert {r.key: r.value for r in profiles.blended(table, "l", "r", 0.4).collect()}["tone"] == "warm"


@pytest.mark.parametrize("sent", [0, 300_000])
def test_only_open_paragraphs_are_shuffled(spark, monkeypatch, sent):
    """Paragraphs that known words fill go no further, and word tables beyond the size are joined by shuffle with the same result."""
    monkeypatch.setattr(families, "SENT", sent)
    full = "known known fox"
    docs = spark.createDataFrame([(1, f"{full}\n\nfox foxes\n\nknown fox\n\nfox"), (2, "\n\n".join([full] * 50)), (3, None), (4, "")], "doc_id long, text string")
    members, known = spark.createDataFrame([("fox", "fox"), ("foxes", "fox"), ("owl", "owl")], "word string, stem string"), spark.createDataFrame([("known",), ("known",)], "word string")
    kept = []
    monkeypatch.setattr(families, "cut", lambda d: kept.append(d) or d)
    assert [tuple(r) for r in families.tipped(docs, members, known).collect()] == [("fox", 2)]
    assert kept[-1].count() == 3
    assert sorted(map(tuple, families.evidence(docs, members).collect())) == [("fox", 2, 2, 55), ("owl", 1, 0, 0)]
