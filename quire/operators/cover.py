"""Copied runs of words: windows of a source that stand in a document, as runs and as windows that don't overlap.

Every word is hashed once; windows are two 64-bit hashes each of their words' hashes. The first is rolled over an Arrow batch at once. A bitmap of the
source's windows (BITS bits whatever its size) goes to every task, and only windows that have their bit leave it and get the second; the join confirms
them. Documents are rows: repeated rows are covered each for itself. Null and short texts hold no window. Extra columns are ignored. Places count words from 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

from .intervals import first_come

BITS = 1 << 25
_STEP = 0x9E3779B97F4A7C15


def _windows(words: Column, n: int, *seed: Column) -> Column:
    """The hash of every n consecutive words."""
    hashes = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.xxhash64(F.slice(t, i, n), *seed))
    return T.bound(words, lambda t: F.when(F.size(t) >= n, hashes(t)).otherwise(F.array().cast("array<bigint>")))


def _rolled(values: np.ndarray, n: int) -> np.ndarray:
    """The hash (int64) of every n consecutive values (uint64)."""
    last = max(len(values) - n + 1, 0)
    h = values[:last].copy()
    for j in range(1, n):
        h *= np.uint64(_STEP)
        h += values[j : last + j]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def _placed(lists, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lists of word hashes: all of them flat, and of each window of n words within a list its list, its place there and its place in the flat ones."""
    sizes = np.diff(lists.offsets.to_numpy())
    counts = np.maximum(sizes - (n - 1), 0)
    of = np.repeat(np.arange(len(sizes)), counts)
    start = np.arange(len(of)) - (np.cumsum(counts) - counts)[of]
    return lists.flatten().to_numpy(), of, start, start + (np.cumsum(sizes) - sizes)[of]


def _known(n: int):
    """Arrow batches (word hashes, g of every window) to (h, g)."""

    def run(batches):
        for batch in batches:
            words, _, _, at = _placed(batch.column(0), n)
            yield pa.RecordBatch.from_arrays([pa.array(_rolled(words.view(np.uint64), n)[at]), batch.column(1).flatten()], ["h", "g"])

    return run


def _bitmap(values: DataFrame) -> np.ndarray:
    """Bits of the low bits of column h, put together in tasks and collected by one job however many partitions hold them."""
    bit = F.col("h").bitwiseAND(F.lit(BITS - 1)) + 1
    held = values.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for row in held.collect():
        start = (row.k - 1) * len(row.bits)
        out[start : start + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return out


def _hits(bits, n: int):
    """Arrow batches (row, doc_id, word hashes) to (row, doc_id, start, h, words) of the windows that have their bit."""

    def run(batches):
        for batch in batches:
            words, of, start, at = _placed(batch.column(2), n)
            h = _rolled(words.view(np.uint64), n)[at]
            bit = h & (BITS - 1)
            hit = np.flatnonzero((bits.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
            take = pa.array(of[hit])
            windows = pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1, dtype=np.int32) * n), pa.array(words[at[hit][:, None] + np.arange(n)].ravel()))
            columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(start[hit].astype(np.int32)), pa.array(h[hit]), windows]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "start", "h", "words"])

    return run


def copied_windows(docs: DataFrame, sources: DataFrame, n: int = 10) -> DataFrame:
    """row, doc_id, start of every window of n words that a source (item_id, text) holds too."""
    words = lambda: F.transform(T.words(F.col("text")), lambda w: F.xxhash64(w)).alias("w")
    known = sources.select(words()).where(F.size("w") >= n).select("w", _windows(F.col("w"), n, F.lit(1)).alias("g"))
    known = known.mapInArrow(_known(n), "h long, g long").distinct()
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(known))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words())
    hits = rows.where(F.size("w") >= n).mapInArrow(_hits(bits, n), "row long, doc_id long, start int, h long, words array<long>")
    hits = hits.withColumn("g", F.xxhash64("words", F.lit(1)))
    return hits.join(known, ["h", "g"], "left_semi").select("row", "doc_id", "start")


def copied_runs(docs: DataFrame, sources: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, start, words of the maximal runs of consecutive copied windows."""
    w = copied_windows(docs, sources, n)
    island = F.col("start") - F.row_number().over(Window.partitionBy("row").orderBy("start"))
    runs = w.withColumn("island", island).groupBy("row", "doc_id", "island").agg(F.min("start").alias("start"), F.count("*").alias("k"))
    return runs.select("doc_id", "start", (F.col("k") + (n - 1)).alias("words"))


def lifted_spans(docs: DataFrame, sources: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, start of copied windows taken from the left without overlap: a lifted sentence is one finding."""
    w = copied_windows(docs, sources, n).withColumn("end", F.col("start") + n)
    return first_come(w, ["row"], ["end"]).where("chosen").select("doc_id", "start")
