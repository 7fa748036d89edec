"""Aggregates over a corpus: presence rates, detector scores, n-gram mining, series, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def presence_rates(docs: DataFrame) -> DataFrame:
    """Shares of documents with a digit or a line break, mean and median characters, by language; means over non-empty texts only."""
    has = lambda c: F.round(100 * F.avg(c.cast("double")), 4)
    n = F.length("text")
    return docs.groupBy("lang").agg(
        F.count("*").alias("docs"),
        has(F.col("text").rlike("[0-9]")).alias("digit_pct"),
        has(F.col("text").contains("\n")).alias("multiline_pct"),
        F.round(F.avg(F.when(n > 0, n)), 4).alias("mean_chars"),
        F.round(F.percentile(n.cast("double"), 0.5), 4).alias("median_chars"),
    )


def wilson(flagged: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score bounds of a rate."""
    p = flagged / n
    mid, wide = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - wide) / (1 + z * z / n), (mid + wide) / (1 + z * z / n)


def detector_score(docs: DataFrame, labels: DataFrame, flag: Column) -> DataFrame:
    """How often `flag` holds by language (and `all`) and quality label, with Wilson bounds."""
    d = docs.join(labels.select("doc_id", "quality"), "doc_id").withColumn("flag", flag.cast("int"))
    g = d.groupingSets([["lang", "quality"], ["quality"]], "lang", "quality").agg(F.grouping("lang").alias("g"), F.count("*").alias("n"), F.sum("flag").alias("flagged"))
    lo, hi = wilson(F.col("flagged"), F.col("n"))
    group = F.when(F.col("g") == 1, "all").otherwise(F.col("lang"))
    return g.select(group.alias("lang"), "quality", "n", "flagged", F.round(F.col("flagged") / F.col("n"), 6).alias("rate"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def ngram_mining(turns: DataFrame, top: int = 20) -> DataFrame:
    """The commonest 2-, 3- and 4-grams of assistant turns; ties by gram."""
    w = turns.where("role = 'assistant'").select(T.words(F.col("text")).alias("w"))
    grams = [w.select(F.lit(n).alias("n"), F.explode(T.ngrams(F.col("w"), n)).alias("gram")) for n in (2, 3, 4)]
    g = grams[0].unionByName(grams[1]).unionByName(grams[2]).groupBy("n", "gram").agg(F.count("*").alias("hits"))
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("hits"), "gram"))
    return g.withColumn("rank", rank).where(F.col("rank") <= top)


def trend(events: DataFrame, days: int = 7) -> DataFrame:
    """Events a day of each type: mean of the first and last `days` days that have any, and their ratio."""
    daily = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type")  # a row per day
    d = daily.withColumn("a", F.row_number().over(w.orderBy("day"))).withColumn("z", F.row_number().over(w.orderBy(F.desc("day"))))
    g = d.groupBy("event_type").agg(F.count("*").alias("days"), F.avg(F.when(F.col("a") <= days, F.col("n"))).alias("e"), F.avg(F.when(F.col("z") <= days, F.col("n"))).alias("l"))
    return g.select("event_type", "days", F.round("e", 6).alias("early_mean"), F.round("l", 6).alias("late_mean"), F.round(F.col("l") / F.col("e"), 6).alias("ratio"))


def digest_dedup(docs: DataFrame) -> DataFrame:
    """Every document with the SHA-256 of its text and the first document that has it; null texts are equal to each other."""
    d = docs.select("doc_id", F.sha2("text", 256).alias("digest"))
    first = d.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    d = d.join(first.withColumnRenamed("digest", "same"), F.col("digest").eqNullSafe(F.col("same")))
    return d.select("doc_id", "digest", "first_id", (F.col("doc_id") == F.col("first_id")).alias("kept"))
