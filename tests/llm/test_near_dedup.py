import random

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import near_dedup
from quire.llm.common import components
from quire.llm.near_dedup import deduplicate, near_duplicates, superminhash
from quire.llm.words import shingle_set


def brute(rows, k=4):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def family(n=60, words=120, seed=3):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 4000)}" for _ in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(r.randint(0, 9)):
            own[r.randrange(words)] = f"x{r.randint(0, 10**6)}"
        rows.append((i, " ".join(own)))
    return rows


def test_components_of_a_family_equal_brute_force(docs_of):
    rows = family() + [(900, ""), (901, None), (902, "one"), (903, "ONE"), (904, "a b c"), (905, rows_of_one_word())]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs_of(rows), k=4).collect()}
    assert got == brute(rows)


def rows_of_one_word():
    return "same " * 30_000


def test_repeated_rows_and_null_ids(docs_of):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "q r s t")]
    got = sorted(map(tuple, near_duplicates(docs_of(rows), k=4).collect()), key=str)
    assert got == sorted([(5, 3, 5, True), (5, 3, 5, True), (None, 3, 5, False), (7, 1, 7, True)], key=str)


def test_empty_table(docs_of):
    assert near_duplicates(docs_of([]), k=4).count() == 0


def test_deduplicate_keeps_columns_and_one_of_each_group(docs_of):
    docs = docs_of([(2, "a b c d e f g"), (1, "A b c d e f g"), (3, "z y x w v u t")])
    kept = deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_superminhash_estimates_similarity():
    r = np.random.default_rng(1)
    x = np.unique(r.integers(0, 2**63, 1000).astype(np.uint64))
    y = np.concatenate([x[:800], np.unique(r.integers(0, 2**63, 200).astype(np.uint64))])
    m = 1024
    assert abs((superminhash(x, m) == superminhash(y, m)).mean() - 800 / 1200) < 0.06
    assert (superminhash(x[:1], 64) < np.iinfo(np.uint64).max).all()  # one element fills every register
    assert len(np.unique(superminhash(x[:1], 64) >> np.uint64(48))) == 64  # each in a round of its own


def test_shingles_split_on_ascii_space_only():
    assert len(shingle_set("a b c".encode(), 4)) == 1 and len(shingle_set(b"A b\x0bc\x0cd E", 4)) == 2


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(edges, "a", "b").collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_blocks_lose_no_link_between_two_thousand_pairs_at_the_threshold():
    """Pairs of sets just above 0.8, in blocks as buckets make them, each in every band that it shares: every pair leaves once."""
    r, lost = np.random.default_rng(5), 0
    kind = pa.struct([("cls", pa.binary()), ("root", pa.binary()), ("keys", pa.binary()), ("sketch", pa.binary()), ("level", pa.int32())])
    schema = pa.schema([("j", pa.int32()), ("x", pa.list_(kind)), ("y", pa.list_(kind)), ("alone", pa.bool_())])
    for i in range(2000):
        n = 180 if i % 4 else 3000
        common = r.integers(0, 2**63, 8 * n // 9, dtype=np.int64).astype(np.uint64)
        block = []
        for side in range(2):
            x = np.unique(np.concatenate([common, r.integers(0, 2**63, n - len(common), dtype=np.int64).astype(np.uint64)]))
            level = near_dedup._level(len(x))
            block.append({"cls": b"%d %d" % (i, side), "root": b"%d %d" % (i, side), "keys": near_dedup._band_keys(superminhash(x), 4).tobytes() if i % 4 else bytes(256), "sketch": near_dedup._thinned(near_dedup._short(x), level).tobytes(), "level": level})
        keys = [np.frombuffer(m["keys"], np.int64) for m in block]
        shared = np.flatnonzero(keys[0] == keys[1])
        rows = pa.RecordBatch.from_pylist([{"j": int(j), "x": block[:1], "y": block[1:], "alone": False} for j in shared], schema)
        left = sum(b.num_rows for b in near_dedup._blocks(80)([rows]))
        lost += left != (len(shared) > 0)
    assert lost == 0


def test_blocks_screen_whole_sets_exactly():
    r = np.random.default_rng(6)
    own = np.unique(r.integers(0, 2**63, 100, dtype=np.int64).astype(np.uint64))
    others = [np.sort(np.concatenate([own[:c], r.integers(0, 2**63, 100 - c, dtype=np.int64).astype(np.uint64)])) for c in (100, 90, 89, 88, 70, 0)]
    assert near_dedup._near([(near_dedup._short(x), 0) for x in others], near_dedup._short(own), 0, 80).tolist() == [True, True, True, False, False, False]


def test_other_similarities_get_other_bands(docs_of):
    assert [near_dedup.banding(p) for p in (95, 80, 50, 20)] == [8, 4, 2, 1]
    with pytest.raises(ValueError):
        near_dedup.banding(5)
    rows = [(1, "a b c d e f"), (2, "a b c d e x"), (3, "q r s t u v")]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs_of(rows), k=2, percent=50).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_deduplicate_keeps_one_row_of_each_group(docs_of):
    a, b = "a b c d e f g", "t u v w x y z"
    rows = [(None, ""), (None, a), (1, a), (5, b), (5, b), (None, "only null ids here now"), (None, "only null ids here now"), (8, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in deduplicate(docs_of(rows)).collect()), key=str)
    assert got == sorted([(None, ""), (1, a), (5, b), (None, "only null ids here now"), (8, "")], key=str)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2), (2, "a b c", 1, 2)], "doc_id long, text string, key long, root int")
    assert deduplicate(docs).columns == docs.columns and deduplicate(docs).count() == 1


def test_blocks_of_a_bucket_meet(docs_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = family(50, 60, 8)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs_of(rows), k=4).collect()}
    assert got == brute(rows)
