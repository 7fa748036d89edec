"""Stylometry: marker rates, writers' baselines, Burrows' Delta.

A writer is a value of `source`. Markers are counted within a batch of texts, and a document is one row with a list of those that occur, so that
no task holds an entry per document and marker, nor per document and writer. Rates of zero enter means and deviations through sums over
the writer's document count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

MEASURES = ["word_count", "avg_sentence_words", "burstiness", "ttr"]


def _listed(of: np.ndarray, rows: int, words: np.ndarray, marker: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """Entries in order of their rows `of` as a list for each row."""
    offsets = np.searchsorted(of, np.arange(rows + 1))
    kinds = (("words", words, pa.int32()), ("marker", marker, pa.int32()), ("n", n, pa.int64()), ("x", 1000.0 * n / words, pa.float64()))
    entries = pa.StructArray.from_arrays([pa.array(v, t) for _, v, t in kinds], [k for k, _, _ in kinds])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)


def _counted(batches):
    """Arrow batches (source, doc_id, words) to (source, doc_id, found) of the texts with a word."""
    for batch in batches:
        lists = batch.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        marker = pc.fill_null(pc.index_in(flat, value_set=pa.array(T.MARKERS, flat.type)), -1).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(sizes)), sizes)
        cells, n = np.unique((of * len(T.MARKERS) + marker)[marker >= 0], return_counts=True)
        of = cells // len(T.MARKERS)
        found = _listed(of, len(sizes), sizes[of], cells % len(T.MARKERS), n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["source", "doc_id", "found"]).filter(pa.array(sizes > 0))


def _merged(batches):
    """Arrow batches (source, doc_id, found): entries of a row with equal words and marker become one."""
    for batch in batches:
        lists = batch.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        words, marker, n = (x.to_numpy() for x in lists.flatten().flatten()[:3])
        keys = np.stack([np.repeat(np.arange(len(sizes)), sizes), words, marker])
        order = np.lexsort(keys[::-1])
        keys = keys[:, order]
        first = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))[: len(order)])
        of, words, marker = keys[:, first]
        found = _listed(of, len(sizes), words, marker, np.add.reduceat(n[order], first) if len(first) else n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["source", "doc_id", "found"])


def _marked(docs: DataFrame) -> DataFrame:
    """source, doc_id, found of the English documents with a word: {words, marker, n, x} of each marker that occurs, `marker` its place in MARKERS, x its rate.

    Each id of a writer is one row. Its texts of as many words count together.
    """
    d = docs.where("lang = 'en'").select("source", "doc_id", T.words(F.col("text")).alias("w"))
    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in ("source", "doc_id"))
    schema = f"{kinds}, found array<struct<words: int, marker: int, n: bigint, x: double>>"
    rows = d.mapInArrow(_counted, schema).groupBy("source", "doc_id").agg(F.flatten(F.collect_list("found")).alias("found"))  # of one document
    return rows.mapInArrow(_merged, schema)


def _counts(marked: DataFrame) -> DataFrame:
    e = marked.select("source", "doc_id", F.explode("found").alias("e"))
    return e.select("source", "doc_id", "e.words", F.get(F.array(*map(F.lit, T.MARKERS)), F.col("e.marker")).alias("marker"), "e.n", "e.x")


def marker_counts(docs: DataFrame) -> DataFrame:
    """source, doc_id, words, marker, n for every marker that occurs in an English document."""
    return _counts(_marked(docs)).drop("x")


def marker_rates(docs: DataFrame) -> DataFrame:
    """doc_id, marker, n and its rate in a thousand words, for every marker that occurs in an English document. Null and empty texts have none."""
    return marker_counts(docs).select("doc_id", "marker", "n", F.round(1000.0 * F.col("n") / F.col("words"), 6).alias("per_1k"))


def _baseline(marked: DataFrame) -> DataFrame:
    writers = marked.groupBy("source").agg(F.count("*").alias("docs"))
    x = F.col("x")
    sums = _counts(marked).groupBy("source", "marker").agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    b = sums.join(writers, "source")
    mean = F.col("s") / F.col("docs")
    var = (F.col("q") - F.col("docs") * mean * mean) / (F.col("docs") - 1)
    sd = F.when(F.col("docs") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(F.lit(0.0))
    return b.select("source", "marker", "docs", mean.alias("mean"), sd.alias("sd"), F.greatest(sd, 0.25 * mean, F.lit(0.5)).alias("floored_sd"))


def marker_baseline(docs: DataFrame) -> DataFrame:
    """Mean, sample deviation and floored deviation of each marker over a writer's English documents with words."""
    return _baseline(_marked(docs))


def _profiles(baseline: DataFrame, zero: Column) -> DataFrame:
    """source, docs, all_absent, profile: a row per writer with {mean, floored_sd, absent} of every marker in order, null where it has none.

    `absent` is the share of a marker that a document lacks, whose distance is `zero`.
    """
    b = baseline.withColumn("absent", F.least(zero / F.col("floored_sd"), F.lit(4.0)))
    known = F.map_from_entries(F.collect_list(F.struct("marker", F.struct("mean", "floored_sd", "absent"))))
    g = b.groupBy("source", "docs").agg(F.sum("absent").alias("all_absent"), known.alias("known"))
    return g.select("source", "docs", "all_absent", F.transform(F.array(*map(F.lit, T.MARKERS)), lambda m: F.try_element_at("known", m)).alias("profile"))


def _distance(mean_of) -> Column:
    """Delta of a document's `found` to a `profile`: mean of |z| up to 4 over all markers.

    Markers that a document lacks have rate 0. Their share of the sum is taken from the writer's total for absent markers less
    that of the markers the document has, so a document's list is passed once.
    """

    def add(a: Column, e: Column) -> Column:
        p = F.get("profile", e["marker"])
        z = F.least(F.abs(e["x"] - mean_of(p["mean"], e["x"])) / p["floored_sd"], F.lit(4.0))
        return a + F.coalesce(z - p["absent"], F.lit(0.0))

    own = F.when(F.col("doc_id").isNotNull(), F.aggregate("found", F.lit(0.0), add)).otherwise(F.lit(0.0))
    return (F.col("all_absent") + own) / len(T.MARKERS)


def _self_distance(marked: DataFrame, baseline: DataFrame, hint: str) -> DataFrame:
    """Delta of each document to its writer's baseline without the document itself: (sum - x) / (n - 1). The hint is of the join with profiles; none sorts documents by writer."""
    n = F.col("docs")
    profiles = _profiles(baseline.where("docs > 1"), F.col("mean") * n / (n - 1))
    return marked.join(profiles.hint(hint), "source").select("source", "doc_id", _distance(lambda mean, x: (mean * n - x) / (n - 1)).alias("delta"))


def self_distance(docs: DataFrame) -> DataFrame:
    """Leave-one-out Delta of each document within its writer."""
    marked = _marked(docs)
    return _self_distance(marked, _baseline(marked), "shuffle_hash").select("source", "doc_id", F.round("delta", 6).alias("delta"))


def voice_distance(docs: DataFrame) -> DataFrame:
    """Delta of each English document to every writer's baseline, with the verdict against the writer's largest leave-one-out Delta.

    A row per document and writer (`baseline`). Writers with a single document have no band and give no rows. The writers' profiles, a row
    of some 8 KB each, go to every task, where each document's list meets them one by one; nothing is grouped by document and writer.
    """
    marked = _marked(docs)
    baseline = _baseline(marked)
    band = _self_distance(marked, baseline, "broadcast").groupBy("source").agg(F.max("delta").alias("band"))
    profiles = _profiles(baseline, F.col("mean")).join(band, "source").withColumnRenamed("source", "baseline")
    d = marked.crossJoin(F.broadcast(profiles)).select("source", "doc_id", "baseline", "band", _distance(lambda mean, x: mean).alias("delta"))
    verdict = F.when(F.col("delta") <= F.col("band"), "in_range").when(F.col("delta") <= 1.5 * F.col("band"), "near").otherwise("out_of_range")
    return d.select("source", "doc_id", "baseline", F.round("delta", 6).alias("delta"), verdict.alias("verdict"))


def long_measures(docs: DataFrame) -> DataFrame:
    """source, doc_id, measure, value for each measure that a document has."""
    from .stats import document_stats

    s = document_stats(docs, "source")
    pairs = F.expr("stack({}, {}) as (measure, value)".format(len(MEASURES), ", ".join(f"'{m}', cast({m} as double)" for m in MEASURES)))
    return s.select("source", "doc_id", pairs).where("value is not null")


def measure_stats(docs: DataFrame) -> DataFrame:
    """Number, mean, sample deviation (0 of one document), least and largest value of each measure by writer. Null measures count for nothing."""
    v = F.col("value")
    m = long_measures(docs).groupBy("source", "measure").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    return m.select("source", "measure", "n", F.round("mean", 4).alias("mean"), F.round(F.coalesce("sd", F.lit(0.0)), 4).alias("sd"), F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


def measure_gaps(docs: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """How many deviations each measure of a document lies off its writer's mean; the deviation is at least a tenth of the mean."""
    m = long_measures(docs)
    b = m.groupBy("source", "measure").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    d = m.join(b, ["source", "measure"])
    used = F.greatest("sd", 0.1 * F.abs("mean"))
    off = F.when(used > 0, (F.col("value") - F.col("mean")) / used)
    return d.select("doc_id", "measure", F.round(off, 4).alias("sd_off"), (F.abs(F.round(off, 4)) <= tolerance).alias("within"))


def sentence_shape(docs: DataFrame) -> DataFrame:
    """Deciles, mean and shares of short (to 8 words) and long (from 30) sentences by writer."""
    s = docs.select("source", F.explode(T.sentence_lengths(F.col("text"))).alias("n"))
    q = F.percentile("n", F.array(*(F.lit(i / 10) for i in range(1, 10))))
    g = s.groupBy("source").agg(
        F.count("*").alias("sentences"), q.alias("q"), F.avg("n").alias("m"),
        F.avg((F.col("n") <= 8).cast("double")).alias("a"), F.avg((F.col("n") >= 30).cast("double")).alias("b"),
    )
    deciles = [F.round(F.col("q")[i], 4).alias(f"d{i + 1}") for i in range(9)]
    return g.select("source", "sentences", *deciles, F.round("m", 4).alias("mean"), F.round("a", 6).alias("short_share"), F.round("b", 6).alias("long_share"))


def sentence_openers(docs: DataFrame, top: int = 8) -> DataFrame:
    """The commonest first words of sentences by writer; ties by word."""
    s = docs.select("source", F.explode(T.sentences(F.col("text"))).alias("s")).select("source", F.get(T.words(F.col("s")), F.lit(0)).alias("word"))
    g = s.where("word is not null").groupBy("source", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "word"))
    return g.withColumn("rank", rank).where(F.col("rank") <= top)


def term_profile(docs: DataFrame, top: int = 12) -> DataFrame:
    """Documents and hits of the commonest markers by writer; ties by marker."""
    g = marker_counts(docs).groupBy("source", "marker").agg(F.count("*").alias("docs"), F.sum("n").alias("hits"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("hits"), "marker"))
    return g.withColumn("rank", rank).where(F.col("rank") <= top)
