"""Statistics of single documents: one row in, one row out, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T


def document_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """Words, sentences, vocabulary and sentence rhythm of each document (doc_id, text), with the columns in keep.

    A null text has null counts; an empty one has 0 words and null measures. Repeated rows are returned as they come.
    """
    d = docs.select("doc_id", *keep, T.words(F.col("text")).alias("w"), T.sentence_lengths(F.col("text")).alias("n"))
    mean, sd = T.mean_of(F.col("n")), T.sd_of(F.col("n"))
    return d.select(
        "doc_id",
        *keep,
        F.size("w").alias("word_count"),
        F.size("n").alias("sentence_count"),
        F.size(F.array_distinct("w")).alias("n_types"),
        F.when(F.size("w") > 0, F.round(F.size(F.array_distinct("w")) / F.size("w"), 6)).alias("ttr"),
        F.round(mean, 6).alias("avg_sentence_words"),
        F.round(sd, 6).alias("sentence_sd"),
        F.round(F.when(mean > 0, sd / mean), 6).alias("burstiness"),
        F.array_max("n").alias("longest_sentence"),
        F.array_min("n").alias("shortest_sentence"),
    )


def moving_ttr(docs: DataFrame, window: int = 100) -> DataFrame:
    """Moving type-token ratio of documents with `window` words or more."""
    d = docs.select("doc_id", T.words(F.col("text")).alias("w")).where(F.size("w") >= window)
    return d.select("doc_id", F.round(T.moving_ttr(F.col("w"), window), 6).alias("mattr"))


def trigram_repetition(docs: DataFrame) -> DataFrame:
    """Share of trigrams that repeat an earlier one; 0 without trigrams."""
    d = docs.select("doc_id", T.ngrams(T.words(F.col("text")), 3).alias("g"))
    share = (F.size("g") - F.size(F.array_distinct("g"))) / F.size("g")
    return d.select("doc_id", F.size("g").alias("n_trigrams"), F.when(F.size("g") > 0, F.round(share, 6)).otherwise(F.lit(0.0)).alias("trigram_repetition"))


def readability(docs: DataFrame) -> DataFrame:
    """Syllables and Flesch-Kincaid grade of English documents with words."""
    d = docs.where("lang = 'en'").select("doc_id", T.words(F.col("text")).alias("w"), F.size(T.sentences(F.col("text"))).alias("s"))
    total = F.aggregate(F.transform("w", T.syllables), F.lit(0), lambda a, x: a + x)
    d = d.where("size(w) > 0 and s > 0").select("doc_id", F.size("w").alias("n"), "s", total.alias("syllables"))
    grade = 0.39 * (F.col("n") / F.col("s")) + 11.8 * (F.col("syllables") / F.col("n")) - 15.59
    return d.select("doc_id", "syllables", F.round(grade, 6).alias("grade"))


def ascii_share(docs: DataFrame) -> DataFrame:
    """Documents and characters of each language, and the share of characters below U+0080."""
    ascii_chars = F.length(F.regexp_replace("text", r"[^\x00-\x7F]", ""))
    d = docs.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(ascii_chars).alias("ascii"))
    return d.select("lang", "docs", "chars", F.round(F.col("ascii") / F.col("chars"), 6).alias("ascii_share"))
