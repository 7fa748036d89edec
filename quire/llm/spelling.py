"""Spelling variant grouping by a symmetric-delete join.

A word emits itself and its distinct single deletions as 64-bit keys; words that share a key are candidates,
and those at edit distance exactly one are near. A near pair shares one key only (the shorter word, or
the rest around the replaced letter), so nothing is counted twice. A word's form is its near word of
largest count, if that is `ratio` times its own; counts grow along forms, so a chain has at most
log(count) words, and joining the chain with itself follows all of them in a few rounds.

Keys come from prefix hashes, one step a letter, so that a word of a million letters makes a million small rows. Up to
CARRIED letters a word travels with its keys; longer ones travel as a digest and are fetched to be compared. A key
stands for words that differ from it by one letter, so its group is bounded by alphabet times length.

Null texts have no words. A null doc_id reads as an empty string in the mark of a run. Repeated rows count as often as
they come. Bytes that are not UTF-8 end a run. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, small, texts
from .memos import turn
from .words import mix

#: One run in so many, by the CRC of `<doc_id>:<run>`, loses a letter.
MARKED = 199
#: Letters of a word that travels with its keys.
CARRIED = 64
#: Distinct words and their letters that a task counts before it hands the counts on.
HELD, LETTERS = 100_000, 4 << 20
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


def _counted(least: int):
    """Arrow batches (doc_id, text) to (word, n): counts of words of at least `least` letters, by parts of a task."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def flush(counts: Counter):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches):
        turn(__name__, dict)
        counts, held = Counter(), 0
        for part, rows in texts(batches):
            for doc, text in zip(part.column(0).to_pylist(), rows):
                start = zlib.crc32(b"%d:" % doc if doc is not None else b":")
                for word, n in Counter(runs.findall((text or b"").lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % MARKED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    before = len(counts)
                    counts[word] += n
                    held += len(word) * (len(counts) - before)
            if len(counts) > HELD or held > LETTERS:
                yield flush(counts)
                counts, held = Counter(), 0
        yield flush(counts)

    return run


def deletion_keys(word: str) -> np.ndarray:
    """Keys of the word and of its distinct single deletions (of equal letters in a row only the first is deleted)."""
    c = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    powers = np.full(len(c), _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    upto = np.concatenate([[np.uint64(0)], np.cumsum(mix(c.astype(np.uint64) + np.uint64(1)) * powers)])
    at = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    less = upto[at] + (upto[-1] - upto[at + 1]) * _BACK
    return mix(np.concatenate([upto[-1:], less])).view(np.int64)


def _keyed(batches):
    """Arrow batches (word, n) to (key, word, digest, n); of word and digest one is null."""
    turn(__name__, dict)
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            words = part.column(0).to_pylist()
            for lo, hi in _slices(words):
                keys = [deletion_keys(w) for w in words[lo:hi]]
                size = [len(k) for k in keys]
                carried = [w if len(w) <= CARRIED else None for w in words[lo:hi]]
                digests = [None if len(w) <= CARRIED else hashlib.md5(w.encode()).digest() for w in words[lo:hi]]
                take = pa.array(np.repeat(np.arange(hi - lo), size))
                columns = [pa.array(np.concatenate(keys)), pa.array(carried, pa.string()).take(take), pa.array(digests, pa.binary()).take(take), part.column(1).slice(lo, hi - lo).take(take)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "word", "digest", "n"])


def _slices(words: list[str], letters: int = 1 << 17):
    """Stretches of the list of about so many letters."""
    lo = held = 0
    for i, word in enumerate(words):
        held += len(word) + 1
        if held > letters or i == len(words) - 1:
            yield lo, i + 1
            lo, held = i + 1, 0


def word_counts(docs: DataFrame, least: int = 6, times: int = 5) -> DataFrame:
    """(word, n): words of at least `least` letters that occur at least `times` times in all documents."""
    found = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = found.mapInArrow(_counted(least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counts.where(F.col("n") >= times), "words")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, n): every ordered pair of words (word, n) at edit distance one, with the count of `near`."""
    keys = materialize(words.mapInArrow(_keyed, "key long, word string, digest binary, n long"), "keys")
    left = keys.select("key", F.col("word").alias("a"), F.col("digest").alias("a_digest"))
    right = keys.select("key", F.col("word").alias("b"), F.col("digest").alias("b_digest"), "n")
    same = F.col("a").eqNullSafe(F.col("b")) & F.col("a_digest").eqNullSafe(F.col("b_digest"))
    met = left.join(right, "key").where(~same)
    long_words = small(materialize(words.where(F.length("word") > CARRIED).select(F.unhex(F.md5("word")).alias("digest"), "word"), "long"))
    for end in ("a", "b"):
        fetched = long_words.select(F.col("digest").alias(f"{end}_digest"), F.col("word").alias(f"{end}_long"))
        met = met.join(fetched, f"{end}_digest", "left").withColumn(end, F.coalesce(end, f"{end}_long"))
    return met.where(F.levenshtein("a", "b", 1) == 1).select(F.col("a").alias("word"), F.col("b").alias("near"), "n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row (word, form): the last word of the chain of forms. A round doubles the steps taken."""
    found = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        above = small(found).select(F.col("word").alias("root"), F.col("root").alias("top"))
        stepped = found.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved"))
        found = materialize(stepped, "roots")
        if found.where("moved").isEmpty():
            return found.select("word", "root")


def variants(docs: DataFrame, least: int = 6, times: int = 5, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the documents that is long and frequent enough."""
    words = word_counts(docs, least, times)
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    near = near.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    enough = F.col("near_n") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", F.when(enough, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("near_n")).alias("form_n")
    )
    found = materialize(found, "near")
    last = small(roots(found.where("form is not null")))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
