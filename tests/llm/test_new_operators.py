"""Spelling variants, repeated byte strings and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import queries, ranked_search, suffix_dedup
from quire.llm.spelling import deletion_keys, variants


def brute_repeats(texts, length):
    raw = [(t or "").encode() if not isinstance(t, bytes) else t for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for b, g in zip(r, gone[1:]) if not g)
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeats_of(spark, texts, length, **sizes):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = suffix_dedup.remove_repeats(docs, length, **sizes).orderBy("doc_id").collect()
    return [tuple(r)[1:] for r in found]


def passages(rng, n):
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(60)]
    text = lambda k: " ".join(rng.choices(words, k=k))
    shared = [text(40) for _ in range(3)]
    out = [None, "", "short", "a" * 300, "ab" * 150, "a" * 90]
    for _ in range(n):
        s = rng.choice(shared)
        a, b = sorted(rng.sample(range(len(s)), 2))
        out.append(text(rng.randint(0, 30)) + s[a:b] + text(rng.randint(0, 30)))
    copy = list(out[-1])
    copy[len(copy) // 2] = "#"
    return [*out, "".join(copy), out[-2], out[-2]]


@pytest.mark.parametrize("length", [7, 40, 64])
def test_repeats_equal_brute_force(spark, length):
    texts = passages(random.Random(length), 40)
    assert repeats_of(spark, texts, length) == brute_repeats(texts, length)


def test_repeats_across_shards_and_parts(spark):
    rng = random.Random(5)
    texts = passages(rng, 60)
    anchored = suffix_dedup._buffers({b"k": [b"x" * 1000, 1]}, 40, 150)
    assert sum(len(p[2]) - 39 for b in anchored for p in b) == 1000 - 39
    strings, at = [t.encode() for t in texts[6:26] if len(t.encode()) > 80], 37
    bwt, owner, boundary = suffix_dedup.transform(strings, [at] * len(strings), 4)
    names = suffix_dedup.blocks(bwt, 3)
    whole = [strings[o][at + 4 * b : at + 4 * b + 12] for o, b in zip(owner, boundary)]
    for i in range(len(whole)):
        if len(whole[i]) < 12:
            assert names[i] == 0
    ids = {}
    for name, b, w in zip(names, boundary, whole):
        if name:
            assert ids.setdefault(int(name), (b, w)) == (b, w)
    assert len(ids) == len({(b, w) for name, b, w in zip(names, boundary, whole) if name})
    assert repeats_of(spark, texts, 40, shard=4, buffer=150) == brute_repeats(texts, 40)


def test_bitmap_takes_as_many_jobs_for_any_partitions(spark):
    context, conf = spark.sparkContext, {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    values = [3, 32768, -1, suffix_dedup.BITS + 9, 5 * 32768 + 1]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        context.setJobGroup("bitmap", "bitmap")
        bits = suffix_dedup.bitmap(spark.createDataFrame([(v,) for v in values], "v long"), "v")
        assert len(context.statusTracker().getJobIdsForGroup("bitmap")) < 8
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert suffix_dedup.held(bits, np.array([*values, 4, 32769])).tolist() == [True] * 5 + [False] * 2
    assert int(np.unpackbits(bits).sum()) == 5


def test_repeats_keep_columns_and_bytes(spark, docs_of):
    text = "é" * 30
    docs = docs_of([(1, text), (1, text), (None, None), (2, "x" + text)])
    found = suffix_dedup.without_repeats(docs, 20)
    assert found.columns == ["doc_id", "lang", "n", "line", "cls", "kept", "spans"]
    rows = sorted(found.collect(), key=lambda r: repr(r.doc_id))
    assert [(r.doc_id, bytes(r.kept), [tuple(s) for s in r.spans]) for r in rows] == [(1, b"", [(0, 60)]), (1, b"", [(0, 60)]), (2, b"x", [(1, 61)]), (None, b"", [])]
    assert suffix_dedup.remove_repeats(docs.limit(0), 20).collect() == []
    bad = spark.sql("SELECT 1L AS doc_id, cast(concat(X'FF', cast(repeat('ab', 30) AS binary)) AS string) AS text")
    assert [tuple(r)[1:4] for r in suffix_dedup.remove_repeats(bad, 20).collect()] == [(61, 60, 1)]


@pytest.mark.parametrize("words", [51, 80])
def test_op12_cuts_planted_passages_from_400_bytes_whatever_their_words(spark, tmp_path, words):
    rng = random.Random(words)
    letters = lambda k: "".join(rng.choices("abcdefghij", k=k))
    sizes, texts = [398, 399, 400, 401, 700], []
    for size in sizes:
        passage = " ".join(letters(3) for _ in range(words - 1)) + " "
        passage += letters(size - len(passage))
        assert len(passage) == size and len(passage.split()) == words
        # The bytes around the two copies differ, so none is longer by chance.
        texts += [f"{letters(200)} 1{passage}3 {letters(200)}", f"{letters(200)} 2{passage}4 {letters(200)}"]
    texts += [" ".join(letters(4) for _ in range(200)) for _ in range(5)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    found = [tuple(r)[1:] for r in queries.op12_suffix_dedup(spark, f"file://{tmp_path}").orderBy("doc_id").collect()]
    assert found == brute_repeats(texts, 400)
    assert [r[1] for r in found] == [n for size in sizes for n in [size if size >= 400 else 0] * 2] + [0] * 5


def brute_variants(rows, least, times, ratio):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= times}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        found = [(-m, v) for v, m in words.items() if near(w, v)]
        best = min(found, default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        out[w] = (form, n, len(found), words[form] if form else None)
    rows = []
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, k, m))
    return sorted(rows)


def test_variants_equal_brute_force(spark, docs_of):
    rng = random.Random(3)
    roots = ["".join(rng.choices("abé", k=rng.randint(6, 8))) for _ in range(12)]
    rows = []
    for i in range(200):
        words = []
        for _ in range(40):
            w = rng.choice(roots[: rng.randint(1, len(roots))])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", w[at].upper() + "c"]) + w[at + 1 :]
            words.append(w)
        rows.append((i if i % 9 else None, rng.choice([" ", "1", "—"]).join(words)))
    long_word = "ab" * 5000
    rows += [(1, None), (2, ""), (3, "ß" * 65 + " " + "ß" * 64), (3, "É" * 7)] * 6 + [(i, long_word) for i in range(5)] + [(i, long_word[1:] + " " + long_word[:9]) for i in range(30)]
    got = sorted(tuple(r) for r in variants(docs_of(rows)).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == brute_variants(rows, 6, 5, 5)
    assert any(r[1] and r[2] != r[1] for r in got) or any(r[1] for r in got)
    assert any(len(r[0]) > 64 and r[4] for r in got)


def test_variant_chains_and_edges(spark, docs_of):
    chain = [("aaaaaa", 5), ("aaaaab", 30), ("aaaabb", 200), ("aaabbb", 1500)]
    rows = [(None, " ".join([w] * n)) for w, n in chain]
    got = {r.word: r for r in variants(docs_of(rows), times=5).collect()}
    assert {w: r.root for w, r in got.items()} == {w: "aaabbb" for w, _ in chain}
    assert variants(docs_of([])).collect() == []
    assert len(deletion_keys("aab")) == 3 and len(set(deletion_keys("a" * 100_000))) == 2
    bad = spark.sql("SELECT 1L AS doc_id, cast(concat(cast('abcdefg' AS binary), X'FF', cast('hijklmn' AS binary)) AS string) AS text FROM range(5)")
    assert {r.word for r in variants(bad).collect()} == {"abcdefg", "hijklmn"}


def brute_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, size = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 100 - 75 + (75 * c.total() * n) // size
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i, r[3], -r[0]) for i, r in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def test_search_equals_brute_force(spark, docs_of, monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcé1", k=rng.randint(1, 4))) for _ in range(80)]
    text = lambda k: rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights=range(80, 0, -1), k=k))
    docs = [(i if i % 17 else None, text(rng.randint(1, 60)).upper()) for i in range(400)] + [(7, "AB ab"), (7, "AB ab"), (9, None), (10, "--- ..")]
    docs += [(1000 + i, docs[5][1]) for i in range(30)]
    items = [(i, text(rng.randint(1, 90))) for i in range(20)] + [(3, "ab"), (None, "ab c"), (21, None), (22, ""), (23, docs[5][1])]
    monkeypatch.setattr(ranked_search, "CHUNK", 7)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    got = sorted((tuple(r) for r in ranked_search.search(docs_of(docs), asked, block=50).collect()), key=repr)
    want = brute_search(docs, items, 10)
    assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want]
    assert got == want
    whole = ranked_search.build_index(docs_of(docs), block=50)
    assert whole.count() >= 8
    assert ranked_search.search(docs_of([]), asked).collect() == []
    assert ranked_search.search(docs_of(docs), asked.limit(0)).collect() == []


def test_bit_slices():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 20, (5, 128))
    planes = np.stack([ranked_search.slices(np.arange(128), v, 128, 20) for v in values])
    sparse = ranked_search.slices(np.array([3, 70]), np.array([5, 9]), 128 * 4, 4)
    assert ranked_search.top(sparse, 5, np.arange(512))[0].tolist() == [3, 70]
    total = ranked_search.add_all(planes[None])[0]
    at, scores = ranked_search.top(total, 9, np.arange(128))
    sums = values.sum(0)
    assert sorted(scores.tolist()) == sorted(sums)[-9:] and (sums[at] == scores).all()
    tied = ranked_search.slices(np.arange(64), np.full(64, 6), 64, 3)
    assert sorted(ranked_search.top(tied, 3, np.arange(64)[::-1].copy())[0].tolist()) == [61, 62, 63]
