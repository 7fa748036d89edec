import zlib

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import chunk_store, memos, packing, tokens

TEXTS = [
    "Hello world. Some words, some more words!! THE!! it's we'll",
    "", None, "  two  spaces \n\n new\n line \n", "tab\tand nbsp em", "<|endoftext|> special", "été ñandú çà — “quoted” 日本語 text १२३",
    "reed*** ndsh*** to%%% a | b | c 'tis ,,, ... ., x_y a_ _b 12,345.67 v2.0", "\n", " ", "a" * 5000, "word " * 9000, "é, café. ٣٤ ǆ",
]


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_memo_equals_the_library(ids_of):
    enc = tokens.encoder(tokens.vocabulary())
    for text in TEXTS * 2:
        assert enc.encode(text) == ids_of(text).tobytes(), text
    for _ in range(2):
        assert enc.encode_column(pa.array(TEXTS)) == [ids_of(t).tobytes() for t in TEXTS]
    assert enc.encode_column(pa.array([], pa.string())) == []


def test_a_task_of_another_operator_frees_the_memo():
    freed = []
    memos.turn("a", lambda: freed.append("a"))
    memos.turn("a", lambda: freed.append("a"))
    memos.turn("b", lambda: freed.append("b"))
    memos.turn("a", lambda: freed.append("a"))
    assert freed == ["a", "b"]


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 20)
    enc = tokens.Encoder(tokens.vocabulary())
    for i in range(100):
        enc.encode(f"w{i} x{i}")
    assert sum(map(len, (enc.memo, enc.memo.old, enc.after_space, enc.after_space.old))) < 60


def test_packing_holds_every_token_once(docs_of, ids_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, TEXTS[3])]
    got = packing.pack(docs_of(rows), room=64).collect()
    want = sum(len(ids_of(t)) + 1 for _, t in rows)
    assert sum(r["length"] for r in got) == want
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    for r in got:
        if r["doc_id"] is not None:
            ids = np.append(ids_of(TEXTS[r["doc_id"]]), np.uint32(0)).astype("<u4")
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            assert r["piece"] == 0 or r["length"] == 64


def test_packing_of_nothing(docs_of):
    assert packing.pack(docs_of([])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_the_histogram_and_is_near_the_bound(seed):
    r = np.random.default_rng(seed)
    lengths = np.clip(r.lognormal(5.5, 1.0, 4000).astype(int), 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    steps = packing.plan(counts)
    used = np.zeros_like(counts)
    for pattern, times in steps:
        assert sum(pattern) <= 2048 and times > 0
        np.add.at(used, np.array(pattern), times)
    assert (used == counts).all()
    assert sum(n for _, n in steps) <= -(-lengths.sum() // 2048) + 3


def test_least_squares_finds_exact_repeats():
    counts = np.zeros(11, np.int64)
    counts[[7, 3, 6, 4]] = 40, 40, 25, 25
    rows = packing.patterns(counts)
    x = {tuple(r): v for r, v in zip(rows.tolist(), packing.fit(rows, counts))}
    assert abs(x[(7, 3, 0)] - 40) < 0.5 and abs(x[(6, 4, 0)] - 25) < 0.5
    steps = dict(packing.fitted(counts)[0])
    assert steps[(3, 7)] == 40 and steps[(4, 6)] == 25


@pytest.mark.parametrize("size", [3000, 30_000])
def test_most_pieces_are_placed_by_fitted_patterns(size):
    lengths = np.clip(np.random.default_rng(size).lognormal(6.0, 1.0, size).astype(int), 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    shares = []
    for reserve in packing.RESERVES:
        used, left = packing.fitted(counts, *reserve)
        assert all(sum(p) == 2048 for p, _ in used)
        shares.append(1 - left.sum() / (counts.sum() - counts[2048]))
    assert shares[0] > 0.6 and shares[2] > 0.5
    assert sum(n for _, n in packing.plan(counts)) <= -(-int(counts @ np.arange(2049)) // 2048) + 2


def test_store_round_trip(spark, docs_of, ids_of, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, TEXTS[3])]
    path = f"file://{tmp_path}/store"
    chunk_store.write_store(docs_of(rows), path)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.append(ids_of(t), np.uint32(2)).astype("<u4")
        want.append((start, i, len(ids), zlib.crc32(ids.tobytes()), ids.astype("<u2").tobytes()))
        start += len(ids)
    sums = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in chunk_store.document_sums(spark, path).collect())
    assert sums == [w[:4] for w in want]
    docs = sorted((r["start"], r["doc_id"], bytes(r["ids"])) for r in chunk_store.read_documents(spark, path).collect())
    assert docs == [(w[0], w[1], w[4]) for w in want]
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_store_detects_a_changed_chunk(spark, docs_of, tmp_path):
    path = f"file://{tmp_path}/store"
    chunk_store.write_store(docs_of([(1, "some words here")]), path)
    bad = spark.createDataFrame([(r["digest"], bytes(r["ids"]) + b"\0\0") for r in spark.read.parquet(f"{path}/chunks").collect()], "digest binary, ids binary")
    bad.write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="digest"):
        chunk_store.document_sums(spark, path).collect()


def damaged(spark, docs_of, tmp_path, name, change):
    """A store of some documents with one of its tables changed."""
    path = f"file://{tmp_path}/store-{name}"
    r = np.random.default_rng(2)
    chunk_store.write_store(docs_of([(i, " ".join(f"w{x}" for x in r.integers(0, 999, 900))) for i in range(12)]), path)
    rows = spark.read.parquet(f"{path}/{name}")
    rows = spark.createDataFrame(change(rows.collect()), rows.schema)
    rows.write.mode("overwrite").parquet(f"{path}/{name}")
    return path


@pytest.mark.parametrize(
    "name, change",
    [
        ("chunks", lambda rows: rows[1:]),
        ("recipes", lambda rows: rows[1:]),
        ("recipes", lambda rows: [r.asDict() | {"digests": r["digests"][::-1]} for r in rows]),
        ("recipes", lambda rows: [r.asDict() | {"doc_id": r["doc_id"] + 1} for r in rows]),
        ("manifest", lambda rows: rows[1:]),
    ],
)
def test_what_is_missing_or_changed_is_an_error(spark, docs_of, tmp_path, name, change):
    path = damaged(spark, docs_of, tmp_path, name, change)
    for read in (chunk_store.document_sums, chunk_store.read_documents):
        with pytest.raises(Exception, match="missing|manifest|root"):
            read(spark, path).collect()


def test_files_follow_each_other_and_a_missing_one_is_an_error(spark, docs_of, tmp_path):
    path = f"file://{tmp_path}/store"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunk_store.write_store(docs_of([(i, f"text {i}") for i in range(400)]), path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted((tmp_path / "store" / "recipes").glob("*.parquet"))
    held = [[r["doc_id"] for r in spark.read.parquet(f"file://{f}").collect()] for f in files]
    assert len(files) > 1 and [i for ids in held for i in ids] == list(range(400))
    files[1].unlink()
    with pytest.raises(ValueError, match="manifest"):
        chunk_store.document_sums(spark, path)


def test_the_tree_has_a_single_top(spark, monkeypatch):
    monkeypatch.setattr(chunk_store, "SPAN", 4)
    monkeypatch.setattr(chunk_store, "FANOUT", 3)
    rows = spark.createDataFrame([(2 * i, i, 2, b"r") for i in range(50)], "start long, doc_id long, n_tokens long, root binary")
    tree = chunk_store.merkle_tree(rows).collect()
    by_level = [sorted(r["node"] for r in tree if r["level"] == k) for k in range(5)]
    assert [len(x) for x in by_level] == [25, 9, 3, 1, 0]
    assert [(r["n_docs"], r["n_tokens"]) for r in tree if r["level"] == 3] == [(50, 100)]


def test_equal_passages_share_chunks():
    r = np.random.default_rng(0)
    passage = r.integers(0, 50_000, 6000)
    split = lambda ids: [ids[a:b].tobytes() for a, b in zip([0, *chunk_store.cuts(ids)], chunk_store.cuts(ids))]
    a, b = split(passage), split(np.concatenate([r.integers(0, 50_000, 777), passage]))
    assert len(set(a) & set(b)) >= len(a) - 2 and b"".join(a) == passage.tobytes()


def test_crc_of_parts():
    r = np.random.default_rng(5)
    parts = [r.bytes(int(n)) for n in r.integers(0, 9000, 12)]
    assert chunk_store.combined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_store_of_nothing(docs_of):
    assert chunk_store.store_and_sums(docs_of([])).count() == 0
