"""Line deduplication by a suffix array over line-ID sequences.

Each document is a sequence of line IDs: hashes of its lines that hold a word, without outer
white space. A line that occurs once in the corpus can't be in a repeated run, so only
stretches of repeated lines take part. Distributed prefix doubling ranks all suffixes of these stretches
by their first 1, 2, 4, ... lines: a round pairs each suffix's rank with that of the suffix
so many lines later, and the new ranks are the order of the distinct pairs. Suffixes whose longest common
prefix spans `min_words` words form an interval of the suffix array; its first member in document
order is the original, the others are later copies. Taken from every start forward and from every
end backward, the intervals' runs cover every maximal repeated run of min_words words or more,
and the later copies of those, no other lines, are deleted. A run of min_words words has at
most so many lines, so the rounds do not grow with the corpus.

Documents are ordered by doc_id (null first), then by a hash of the text; rows equal in both count as
one document and get the same result. Where a later copy overlaps its original, the original's lines stay.
Null and empty texts have no lines and stay as they are. Extra columns are kept. A document of which
every line is deleted has an empty text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, running_total, small, texts, wrapped
from .memos import turn

#: Least words of a repeated run; shorter ones (headings, licence lines) stay.
MIN_WORDS = 50
DOC = ["d", "k"]
_LINES = pa.list_(pa.struct([("i", pa.int32()), ("line", pa.int64()), ("n", pa.int32())]))


def _lined(batches):
    """Arrow batches (d, k, text) to (d, k, lines): line number, line ID and words of each line with a word."""
    turn(__name__, dict)  # nothing to remember
    for part, rows in texts(batches):
        out = []
        for text in rows:
            found = []
            for i, line in enumerate((text or b"").split(b"\n")):
                if n := len(line.split()):
                    found.append({"i": i, "line": xxhash.xxh3_64_intdigest(line.strip()) - (1 << 63), "n": n})
            out.append(found)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, _LINES)], ["d", "k", "lines"])


def _ranks(suffixes: DataFrame, *keys: str) -> DataFrame:
    """The distinct keys with `rank`: the number of suffixes with smaller ones."""
    counts = suffixes.groupBy(*keys).agg(F.count("*").alias("c")).select(F.struct(*keys).alias("key"), "c")
    ranked = running_total(counts, "key", "c", "rank").select(*(F.col("key")[k].alias(k) for k in keys), "rank")
    return small(materialize(ranked, "ranks"))


def suffix_ranks(docs: DataFrame, rounds: int) -> DataFrame:
    """Suffixes (d, k, stretch, at, i, n) of stretches of repeated lines, with ranks r0, r1, ... by their first 1, 2, 4, ... lines.

    A second half past the stretch's end ranks before all others.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("k"), F.col("text").cast("string").alias("text"))
    lines = docs.mapInArrow(_lined, "d long, k long, lines array<struct<i: int, line: long, n: int>>").dropDuplicates(DOC)
    lines = materialize(lines.select("d", "k", F.posexplode("lines").alias("at", "x")).select("d", "k", "at", "x.i", "x.line", "x.n"), "lines")
    repeated = lines.groupBy("line").agg(F.count("*").alias("c")).where("c > 1").select("line")
    s = lines.join(small(materialize(repeated, "repeated")), "line")
    s = s.withColumn("stretch", F.col("at") - F.row_number().over(Window.partitionBy(*DOC).orderBy("at")))
    s = materialize(s, "suffixes")
    s = materialize(s.join(_ranks(s, "line"), "line").drop("line").withColumnRenamed("rank", "r0"), "round")
    order = Window.partitionBy(*DOC, "stretch").orderBy("at")
    for j in range(rounds):
        s = s.withColumn("half", F.coalesce(F.lead(f"r{j}", 1 << j).over(order), F.lit(-1)))
        s = materialize(s, "pairs")
        s = materialize(s.join(_ranks(s, f"r{j}", "half"), [f"r{j}", "half"]).drop("half").withColumnRenamed("rank", f"r{j + 1}"), "round")
    return s


def _runs(min_words: int, rounds: int):
    """Arrow batches (d, k, stretch lines) to runs: first line, lines, and the ranks of their first and last power-of-two part.

    Two runs of the same number of lines are equal if both ranks are.
    """

    def run(batches):
        for batch in batches:
            out = []
            for d, k, lines in zip(*(batch.column(c).to_pylist() for c in ("d", "k", "lines"))):
                lines.sort(key=lambda x: x["at"])
                total = np.cumsum([0, *(x["n"] for x in lines)])
                size, found = len(lines), set()
                ends = np.searchsorted(total, total[:-1] + min_words)  # first end with min_words words
                found.update((s, e - s) for s, e in enumerate(ends.tolist()) if e <= size)
                starts = np.searchsorted(total, total[1:] - min_words, "right") - 1  # last start with min_words words
                found.update((s, e - s) for e, s in enumerate(starts.tolist(), 1) if s >= 0)
                for s, length in sorted(found):
                    j = length.bit_length() - 1
                    first, last = lines[s], lines[s + length - (1 << j)]
                    out.append((d, k, first["at"], length, first[f"r{j}"], last[f"r{j}"], [x["i"] for x in lines[s : s + length]]))
            columns = list(zip(*out)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["d", "k", "at", "length", "first", "last", "lines"])

    return run


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, k and the numbers of the lines to delete, for every document (doc_id d, text hash k) that has later copies."""
    min_words = max(min_words, 1)
    rounds = min_words.bit_length() - 1
    s = suffix_ranks(docs, rounds)
    fields = ["at", "i", "n", *(f"r{j}" for j in range(rounds + 1))]
    stretches = s.groupBy(*DOC, "stretch").agg(F.collect_list(F.struct(*fields)).alias("lines")).select("d", "k", "lines")  # of one document
    runs = materialize(stretches.mapInArrow(_runs(min_words, rounds), "d long, k long, at int, length int, first long, last long, lines array<int>"), "runs")
    same = ["length", "first", "last"]
    # The interval of a run: all places where it stands; nulls of d come first in a struct, too.
    intervals = runs.groupBy(*same).agg(F.min(F.struct("d", "k", "at")).alias("origin"), F.count("*").alias("c")).where("c > 1").drop("c")
    copies = runs.join(small(materialize(intervals, "intervals")), same).where(~F.struct("d", "k", "at").eqNullSafe(F.col("origin")))
    # In the original's own document, lines up to its end stay.
    overlap = F.col("d").eqNullSafe(F.col("origin.d")) & (F.col("k") == F.col("origin.k")) & (F.col("at") < F.col("origin.at") + F.col("length"))
    skipped = F.when(overlap, F.col("origin.at") + F.col("length") - F.col("at")).otherwise(0)
    cut = copies.select("d", "k", F.slice("lines", skipped.cast("int") + 1, F.col("length")).alias("lines"))
    cut = cut.select("d", "k", F.explode("lines").alias("line")).groupBy(*DOC).agg(F.sort_array(F.collect_set("line")).alias("lines"))
    return materialize(cut, "cut")


def remove_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, removed: str | None = None) -> DataFrame:
    """docs without later copies of repeated runs; `removed`, if given, names a column for the number of lines deleted."""
    cut = later_copies(docs, min_words).select(F.col("d").alias("cut_d"), F.col("k").alias("cut_k"), F.col("lines").alias("cut"))
    marked = wrapped(docs, d=F.col("doc_id").cast("long"), k=F.xxhash64("text"))
    marked = marked.join(small(cut), F.col("d").eqNullSafe(F.col("cut_d")) & (F.col("k") == F.col("cut_k")), "left")
    kept = F.array_join(F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.array_contains("cut", i)), "\n")
    text = F.when(F.col("cut").isNull(), F.col("row.text")).otherwise(kept).alias("text")
    columns = [text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    if removed:
        columns.append(F.coalesce(F.array_size("cut"), F.lit(0)).alias(removed))
    return marked.select(*columns)
