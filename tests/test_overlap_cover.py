"""Overlapping sets, copied runs, import closure, contents and what edits say, against brute force and hand-made rows."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quire.operators import closure, contents, cover, joins, learning


@pytest.mark.parametrize("percent", [30, 50, 100])
def test_similar_pairs_equal_brute_force(spark, percent):
    rng = random.Random(percent)
    sets = {i: sorted({f"x{int(rng.paretovariate(0.5))}" for _ in range(rng.randint(1, 12))} | ({"hot"} if i % 3 == 0 else set())) for i in range(80)}
    df = spark.createDataFrame(list(sets.items()), "id long, items array<string>")
    got = {(r.first_id, r.doc_id): (r.common, r.smaller) for r in joins.similar_pairs(df, percent).collect()}
    want = {}
    for a in sets:
        for b in sets:
            n, m = len(set(sets[a]) & set(sets[b])), min(len(sets[a]), len(sets[b]))
            if a < b and n and 100 * n >= percent * m:
                want[a, b] = n, m
    assert got == want and len(want) > 20


@pytest.mark.parametrize(("hot", "block"), [(1, 2), (3, 1), (8, 3)])
def test_hot_items_meet_in_groups_and_blocks(spark, hot, block):
    """Every third set holds one item: their pairs, which grow with the square of it, come from groups, and only counts need no pairs."""
    rng = random.Random(hot)
    sets = {i: sorted({f"x{int(rng.paretovariate(0.5))}" for _ in range(rng.randint(1, 12))} | ({"hot"} if i % 3 == 0 else set())) for i in range(70)}
    sets |= {i: ["hot", f"x{i % 2}"] for i in range(70, 80)}
    df = spark.createDataFrame([(i, s, f"m{i}") for i, s in sets.items()], "id long, items array<string>, note string")
    want = {(a, b): (n, m) for a in sets for b in sets for n, m in [(len(set(sets[a]) & set(sets[b])), min(len(sets[a]), len(sets[b])))] if a < b and n and 100 * n >= 30 * m}
    got = joins.similar_pairs(df, 30, "note", hot, block).collect()
    assert {(r.first_id, r.doc_id): (r.common, r.smaller) for r in got} == want and len(got) == len(want) > 400
    assert all((r.first_more, r.doc_more) == (f"m{r.first_id}", f"m{r.doc_id}") for r in got)
    assert {r.id: r.links for r in joins.similar_counts(df, 30, hot).collect()} == {i: n for i in sets if (n := sum(i in p for p in want))}
    assert joins._Met(df, 30, hot).cold.count() <= hot * sum(map(len, sets.values())) / 2


def test_facts_of_overlapping_documents_are_counted(spark):
    line = "a line of more than forty characters, with no number, is here"
    texts = ["7 7 7 8", "7 8 8 9", "10 7", ""]
    docs = spark.createDataFrame([(i, f"{line}\n{t}") for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.first_id, r.doc_id, r.side, r.fact, r.n) for r in joins.fact_delta(docs).collect())
    want = []
    for a in range(4):
        for b in range(a + 1, 4):
            x, y = Counter(texts[a].split()), Counter(texts[b].split())
            want += [(a, b, side, f, n) for side, d in (("lost", x - y), ("added", y - x)) for f, n in d.items()]
    assert got == sorted(want)


def test_line_overlap(spark):
    long = ["a line of more than forty characters, number %d, is here" % i for i in range(6)]
    texts = {1: long[:3], 2: [*long[1:4], "short"], 3: long[:3], 4: ["- " + long[2].upper(), *long[4:]], 5: ["short"], 6: [""]}
    rows = [(i, "\n".join(t), 0) for i, t in texts.items()] + [(7, None, 0), (None, long[0], 0), (1, "\n".join(long[:3]), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, common int")
    assert sorted((r.first_id, r.doc_id, r.common) for r in joins.line_overlap(docs).collect()) == [(1, 2, 2), (1, 4, 1), (2, 4, 1)]
    assert sorted(map(tuple, joins.line_links(docs).select("doc_id", "class_id", "links").collect())) == [(1, 1, 2), (2, 2, 2), (3, 1, 2), (4, 4, 2)]
    assert joins.line_overlap(docs.limit(0)).collect() == []
    numbered = spark.createDataFrame([(1, long[0] + "\nwe saw 1,000 and 7", 0), (2, long[0] + "\nwe saw 1000 and 8", 0), (3, long[0], 0)], "doc_id long, text string, fact int")
    got = sorted((r.first_id, r.doc_id, r.side, r.fact) for r in joins.fact_delta(numbered).collect())
    assert got == [(1, 2, "added", "8"), (1, 2, "lost", "7"), (1, 3, "lost", "1000"), (1, 3, "lost", "7"), (2, 3, "lost", "1000"), (2, 3, "lost", "8")]


def test_copied_runs_equal_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("abc") * rng.randint(1, 3)
    items = [" ".join(word() for _ in range(40)) for _ in range(4)]
    texts = [None, "", "too short"]
    for _ in range(30):
        piece = rng.choice(items).split()
        a, b = sorted(rng.sample(range(41), 2))
        texts.append(" ".join([word() for _ in range(rng.randint(0, 9))] + piece[a:b] + [word() for _ in range(rng.randint(0, 9))]) + "!")
    texts += texts[-2:]
    docs = spark.createDataFrame([(i % 20, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    source = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None)], "item_id long, text string")
    known = {tuple(t.split()[i : i + 5]) for t in items for i in range(36)}
    runs, spans = [], []
    for i, t in enumerate(texts):
        w = (t or "").replace("!", "").split()
        hits = [k for k in range(len(w) - 4) if tuple(w[k : k + 5]) in known]
        upto = -1
        for k in hits:
            if k >= upto:
                spans.append((i % 20, k))
                upto = k + 5
            if k - 1 in hits:
                runs[-1][2] += 1
            else:
                runs.append([i % 20, k, 5])
    assert sorted(map(tuple, cover.copied_runs(docs, source, 5).collect())) == sorted(map(tuple, runs))
    assert sorted(map(tuple, cover.lifted_spans(docs, source, 5).collect())) == sorted(spans)
    assert cover.copied_runs(docs, source.limit(0), 5).collect() == [] and cover.copied_runs(docs.limit(0), source, 5).collect() == []


def test_import_closure(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("a", "b"), ("x", "x"), ("b", None), ("a", "gone"), ("g", "h")]
    files = spark.createDataFrame([(i, n) for n, i in enumerate("abcdefghx", 1)] + [("n", None), (None, 5)], "id string, own long")
    e = spark.createDataFrame(edges, "src string, dst string")
    got = {r.id: (r.own, r.total, r.imports) for r in closure.effective_size(files, e).collect()}
    # From a, in five steps: b, c, a itself and d, e, f.
    assert got["a"] == (1, 1 + 2 + 3 + 1 + 4 + 5 + 6, 6) and got["x"] == (9, 18, 1) and got["h"] == (8, 8, 0) and got["n"] == (0, 0, 0)
    assert got["d"] == (4, 4 + 5 + 6 + 7 + 8, 4) and len(got) == 10
    assert {r.node: r.hop for r in closure.reached(e, 3).where("root = 'a'").collect()} == {"b": 1, "gone": 1, "c": 2, "a": 3, "d": 3}
    assert sorted((r.id, r.priority) for r in closure.import_cost(files, e, 10, 20).collect()) == [("a", "P1"), ("b", "P1"), ("c", "P1"), ("d", "P1"), ("e", "P1"), ("f", "P1"), ("g", "P2"), ("x", "P2")]


def test_contents(spark):
    entry = "Chapter {} .... {}"
    table = "\n".join(entry.format(i, i) for i in range(5))
    late = "\n" * 81
    rows = [(1, "Title\n" + table + "\nbody 7"), (2, table.replace("\n", "\n\n")), (3, late + table), (4, None), (5, ""), (6, "....  3\n" * 9), (7, table + "\nx\n" + table), (7, table)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, at int")
    assert sorted(map(tuple, contents.contents(docs).collect())) == [(1, 2, 6), (7, 1, 5), (7, 1, 5)]


def test_headings(spark):
    text = "intro\n# One ##\nx\n```\n# code\n```\nTwo\n===\n\n---\n  ### Three\n#### deep\n#no\nFour\n--\nend"
    docs = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, line int")
    assert [tuple(r) for r in contents.headings(docs).orderBy("line").collect()] == [(1, 2, "chapter", "One", 6), (1, 7, "chapter", "Two", 10), (1, 11, "section", "Three", 13), (1, 14, "section", "Four", 16)]


@pytest.fixture(scope="module")
def turns(spark):
    rows = [
        (1, 0, "user", "We utilize the gadget. We utilize the widget. But now. But why? Moreover gadgets gadgets."), (1, 1, "user", "We use the gadget. We use the widget. And so? And then?"), (1, 2, "user", None), (1, 3, "user", ""),
        (2, 0, "user", "alone"), (None, 0, "user", "x"), (3, 5, "bot", "the same the same"), (3, 5, "bot", "a same the same"),
    ]
    return spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, word string")


def test_learning(turns):
    assert sorted(map(tuple, learning.substitutions(turns).collect())) == [(1, 0, "utilize", "use", 2)]
    gone = {(r.turn, r.word): r.n for r in learning.removals(turns).where("conv_id = 1").collect()}
    assert gone == {(0, "utilize"): 2, (0, "gadgets"): 2, (1, "gadget"): 1, (1, "widget"): 1}
    moved = {(r.turn, r.opener): (r.before, r.after) for r in learning.opener_changes(turns).collect()}
    assert moved == {(0, "but"): (2, 0), (0, "and"): (0, 2), (1, "we"): (2, 0), (1, "and"): (2, 0)}
    rules = sorted(map(tuple, learning.proposals(turns).collect()), key=repr)
    assert rules == [(1, 0, "removal", "gadgets", None, 2), (1, 0, "removal", "utilize", None, 2), (1, 0, "substitution", "utilize", "use", 2)]
    assert learning.substitutions(turns.limit(0)).collect() == []
    toward = {r.measure: r.toward for r in learning.measure_moves(turns).where("conv_id = 1 and turn = 0").collect()}
    assert set(toward) == {"word_count", "avg_sentence_words", "burstiness", "ttr"} and toward["word_count"]


def test_replacements_equal_the_standard_library():
    rng = random.Random(1)
    for _ in range(50):
        a = rng.choices("abcdefgh", k=rng.randint(0, 30))
        b = [rng.choice("xyz") if rng.random() < 0.2 else w for w in a if rng.random() < 0.9]
        want = [(a[i], b[j]) for tag, i, i2, j, j2 in SequenceMatcher(None, a, b).get_opcodes() if tag == "replace" and (i2 - i, j2 - j) == (1, 1)]
        assert learning.replaced(a, b) == want and all(x != y for x, y in want)


def test_windows_are_of_words(spark):
    d = spark.createDataFrame([("a b c d",)], "text string").select(cover._windows(F.split("text", " "), 3).alias("h"), cover._windows(F.split("text", " "), 9).alias("none")).first()
    assert len(d.h) == 2 and d.none == []


def test_copied_windows_hash_each_word_once(spark):
    """No expression cuts a window out of the documents' words; windows are rolled in tasks and stay within their list."""
    docs = spark.createDataFrame([(1, "x a b c d"), (2, "c d e"), (3, "a b"), (4, None), (5, "")], "doc_id long, text string")
    source = spark.createDataFrame([(1, "a b c d"), (2, "b c d e f"), (3, "a")], "item_id long, text string")
    found = cover.copied_windows(docs, source, 3)
    assert sorted((r.doc_id, r.start) for r in found.collect()) == [(1, 1), (1, 2), (2, 0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("slice(") == 1  # of the source's windows


def test_windows_stay_within_their_list():
    import numpy as np
    import pyarrow as pa

    words, of, start, at = cover._placed(pa.array([[1, 2], [], [3, 4, 5]], pa.list_(pa.int64())), 3)
    assert (of.tolist(), start.tolist(), at.tolist()) == ([2], [0], [2]) and cover._rolled(words.view(np.uint64), 3).shape == (3,)
    assert cover._rolled(words.view(np.uint64), 9).shape == (0,)


def test_contents_cut_only_the_lines_they_look_at(spark):
    docs = spark.createDataFrame([(1, "\n".join(["a .. 1"] * 300)), (2, None), (3, "x" * 200000), (4, "\n".join(["a .. 1"] * 5)), (5, " .. 1\n" * 9)], "doc_id long, text string")
    assert sorted(map(tuple, contents.contents(docs).collect())) == [(1, 1, 200), (4, 1, 5)]
    assert "slice(" in contents.contents(docs)._jdf.queryExecution().optimizedPlan().toString()


def test_bitmap_takes_as_many_jobs_for_any_partitions(spark):
    context, conf = spark.sparkContext, {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    values = [3, 32768, -1, cover.BITS + 9]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        context.setJobGroup("cover bitmap", "bitmap")
        bits = cover._bitmap(spark.createDataFrame([(v,) for v in values], "h long"))
        jobs = len(context.statusTracker().getJobIdsForGroup("cover bitmap"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert jobs < 8
    assert {i for i in (3, 9, 10, 32768, cover.BITS - 1) if bits[i >> 3] >> (i & 7) & 1} == {3, 9, 32768, cover.BITS - 1}


def test_contents_query_reads_texts_to_their_end(spark, tmp_path):
    import duckdb

    from quire.plans import catalog

    # The query makes entries of lines whose length is not divisible by 4.
    late, long = "\n".join(["abcd"] * 250 + ["entry"] * 6 + ["abcd"]), "\n".join(["entry"] * 300)
    docs = spark.createDataFrame([(1, late), (2, long), (3, "abcd\n" * 90 + long), (4, None), (5, "abcd\n" * 300)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, catalog.QUERIES["det_58_contents"](spark, str(tmp_path)).collect()))
    assert found == [(1, 251, 256), (2, 1, 300), (3, 91, 390)]
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(duck.sql(catalog.SQL["det_58_contents"]).fetchall()) == found


def test_line_sets_are_made_once(spark):
    """The filter of empty sets doesn't make them again."""
    docs = spark.createDataFrame([(1, "- A\tlong  line\nshort\n1. a long line"), (2, "short"), (3, None), (4, " \n"), (None, "a long line")], "doc_id long, text string")
    sets = joins.line_sets(docs, 8)
    assert sets._jdf.queryExecution().optimizedPlan().toString().count("[-*+]") == 1
    assert [(r.doc_id, r.lines) for r in sets.collect()] == [(1, ["a long line"])]
