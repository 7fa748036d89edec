"""Line and span level operators: masks, excerpts, normal forms, marks, line findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.markdown import blank


def masked_numbers(docs: DataFrame) -> DataFrame:
    """Each text with numbers masked: its digest, its length, how many characters were masked."""
    m = docs.select("doc_id", "text", blank(F.col("text"), "[0-9][0-9,.]*").alias("m"))
    gone = F.length(F.regexp_replace("m", "[^ ]", "")) - F.length(F.regexp_replace("text", "[^ ]", ""))
    return m.select("doc_id", F.sha2("m", 256).alias("masked_sha"), (F.length("m") == F.length("text")).alias("same_length"), gone.alias("masked"))


def first_number(docs: DataFrame, pad: int = 34) -> DataFrame:
    """Line and excerpt of the first digit of texts that have one."""
    d = docs.select("doc_id", "text", F.length(F.regexp_extract("text", r"^([^0-9]*)[0-9]", 1)).alias("at")).where(F.col("text").rlike("[0-9]"))
    before = F.substring(F.col("text"), F.lit(1), F.col("at"))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    start = F.greatest(F.col("at") - pad, F.lit(0))
    cut = F.substring(F.col("text"), start + 1, F.col("at") + pad - start)
    return d.select("doc_id", line.alias("line"), T.trimmed(F.regexp_replace(cut, r"[ \t\r\n]+", " ")).alias("excerpt"))


def normal_form(text: Column) -> Column:
    """LF line ends, right-trimmed lines, outer blank lines off, one line break at the end."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[ \t]+(\n|\z)", "$1")
    return F.concat(T.trimmed(t), F.lit("\n"))


def normal_digests(docs: DataFrame) -> DataFrame:
    """SHA-256 of each text's normal form, and about how many tokens it holds; null for null texts."""
    return docs.select("doc_id", F.sha2(normal_form(F.col("text")), 256).alias("digest"), F.floor((F.length("text") + 2) / 3).alias("token_estimate"))


def paragraphs(docs: DataFrame, least: int = 25, most: int = 220) -> DataFrame:
    """Lines of `least` to `most` words: the paragraphs that may serve as samples."""
    p = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "p")).select("doc_id", "pos", F.size(T.words(F.col("p"))).alias("n"))
    return p.where(F.col("n").between(least, most))


MARKS = {"commas": ",", "periods": r"\.", "semicolons": ";", "colons": ":", "questions": r"\?", "exclamations": "!", "hashes": "#", "pipes": r"\|"}


def count_marks(docs: DataFrame) -> DataFrame:
    """How often each of MARKS stands in each text; null for null texts."""
    return docs.select("doc_id", *(F.regexp_count("text", F.lit(rx)).alias(name) for name, rx in MARKS.items()))


def count_terms(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Documents and hits of each term, in one pass."""
    w = docs.select("doc_id", F.explode(T.words(F.col("text"))).alias("term")).where(F.col("term").isin(terms))
    return w.groupBy("term", "doc_id").agg(F.count("*").alias("k")).groupBy("term").agg(F.count("*").alias("docs"), F.sum("k").alias("hits"))


def reliability(docs: DataFrame) -> DataFrame:
    """Documents by word-count tier."""
    n = F.size(T.words(F.col("text")))
    tier = F.when(n >= 600, "high").when(n >= 250, "medium").when(n >= 120, "low").otherwise("insufficient")
    return docs.select(tier.alias("tier")).groupBy("tier").agg(F.count("*").alias("docs"))


def block_burstiness(docs: DataFrame) -> DataFrame:
    """Population deviation over mean of the sentence lengths of each line with three or more."""
    p = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "p")).select("doc_id", "pos", T.sentence_lengths(F.col("p")).alias("n")).where(F.size("n") >= 3)
    sd = T.sd_of(F.col("n")) * F.sqrt((F.size("n") - 1) / F.size("n"))
    return p.select("doc_id", "pos", F.round(sd / T.mean_of(F.col("n")), 6).alias("burstiness"))


def ascii_problems(docs: DataFrame, top: int = 5) -> DataFrame:
    """The first `top` lines of a document with a character beyond U+007F, and how many more there are."""
    x = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"[^\x00-\x7F]"))
    w = Window.partitionBy("doc_id")
    x = x.withColumn("rn", F.row_number().over(w.orderBy("pos"))).withColumn("more", F.count("*").over(w) - top)
    return x.where(F.col("rn") <= top).select("doc_id", "pos", F.greatest("more", F.lit(0)).alias("more"))


def passives(docs: DataFrame) -> DataFrame:
    """Auxiliary and a word in -ed: hits of each pair of words, by count."""
    hits = F.regexp_extract_all(F.lower("text"), F.lit(r"((?:is|are|was|were|be|been|being) [a-z]+ed)"), F.lit(1))
    return docs.select("doc_id", F.explode(hits).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("hits"), F.min("doc_id").alias("first_id"))


def picked(docs: DataFrame, least: int = 150, share: float = 0.95) -> DataFrame:
    """Documents of `least` words and an ASCII share of `share`, the first of each digest."""
    ascii_chars = F.length(F.regexp_replace("text", r"[^\x00-\x7F]", ""))
    d = docs.where((F.size(T.words(F.col("text"))) >= least) & (ascii_chars >= share * F.length("text")))
    return d.groupBy(F.sha2(normal_form(F.col("text")), 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"))


def event_sequences(events: DataFrame, first: int = 6) -> DataFrame:
    """The first `first` event types of each user, runs collapsed."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events.withColumn("before", F.lag("event_type").over(w)).where("before is null or before <> event_type")
    e = e.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= first)
    s = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rn", "event_type"))).alias("s"))
    return s.select("user_id", F.array_join(F.transform("s", lambda x: x["event_type"]), " > ").alias("sequence"))


def inflections(docs: DataFrame) -> DataFrame:
    """The commonest words of the corpus (50 uses or more) with their regular forms."""
    w = docs.select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 50")
    c = F.col("word")
    y = c.rlike("[^aeiou]y$")
    stem = F.expr("left(word, length(word) - 1)")
    plural = F.when(y, F.concat(stem, F.lit("ies"))).when(c.rlike("(s|x|z|ch|sh)$"), F.concat(c, F.lit("es"))).otherwise(F.concat(c, F.lit("s")))
    past = F.when(y, F.concat(stem, F.lit("ied"))).when(c.endswith("e"), F.concat(c, F.lit("d"))).otherwise(F.concat(c, F.lit("ed")))
    gerund = F.when(c.rlike("e$") & ~c.rlike("ee$"), F.concat(stem, F.lit("ing"))).otherwise(F.concat(c, F.lit("ing")))
    return w.select("word", plural.alias("plural"), past.alias("past"), gerund.alias("gerund"))
