"""Families of words that share regular forms, with their evidence in a corpus and their reviews.

Families are connected components: labels move along edges and pointers are followed until every word has the least word of its
component; rounds are cut by reliable checkpoints in the folder that spark.checkpoint.dir names. Null words are left out, repeated rows count
once. Extra columns are ignored unless stated. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import inflect
from quire.functions import text as T

from .rounds import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node of its component.

    In a round every node takes the least root among its neighbours', and then its root's root; what an edge joins has one root in the end.
    """
    e = edges.select("a", "b").where("a is not null and b is not null")
    e = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = cut(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = e.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        least = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        above = roots.select(F.col("node").alias("low"), F.col("root").alias("top"))
        moved = cut(least.join(above, "low").select("node", F.least("low", "top").alias("root"), (F.least("low", "top") != F.col("root")).alias("moved")))
        roots = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return roots


def families(candidates: DataFrame, bases: DataFrame) -> DataFrame:
    """word, stem of every candidate (word, lift): two are of one family if both are forms of some base (word) or of another's family.

    The stem is the family's word of most lift, of equal ones the least.
    """
    c = candidates.where("word is not null").groupBy("word").agg(F.max("lift").alias("lift"))
    forms = bases.where("word is not null").select("word").distinct().select(F.col("word").alias("base"), F.explode(inflect.forms(F.col("word"))).alias("word"))
    members = forms.join(c.select("word"), "word").withColumn("first", F.min("word").over(Window.partitionBy("base")))  # of one base's few forms
    roots = components(members.select(F.col("first").alias("a"), F.col("word").alias("b")))
    grouped = c.join(roots.select(F.col("node").alias("word"), "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
    stems = grouped.groupBy("root").agg(F.min(F.struct((-F.col("lift")).alias("less"), "word")).alias("s"))
    return grouped.join(stems, "root").select("word", F.col("s.word").alias("stem"))


#: A table of words of more rows or bytes is not sent to every task.
SENT, SENT_BYTES = 300_000, 16 << 20


def _sent(words: DataFrame) -> DataFrame:
    """The table, computed once, to be broadcast if it is small."""
    words = cut(words)
    n, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    return F.broadcast(words) if n <= SENT and size <= SENT_BYTES else words


def _uses(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys and each word of a text. Explode without outer would cut the text into words again, to filter by their number."""
    return rows.select(*keys, F.explode_outer(T.words(F.col(text))).alias("word")).where("word is not null")


def word_lifts(docs: DataFrame, least: int) -> DataFrame:
    """word, lift of every word that documents use `least` times or more; lift is how often."""
    return _uses(docs, "text").groupBy("word").agg(F.count("*").alias("lift")).where(F.col("lift") >= least)


def evidence(docs: DataFrame, members: DataFrame) -> DataFrame:
    """stem, forms, docs, hits of families (word, stem): how many forms, documents with any of them, and uses. A row is a document."""
    members = _sent(members)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "text")
    per_doc = _uses(rows, "text", "row").join(members, "word").groupBy("stem", "row").agg(F.count("*").alias("k"))
    found = per_doc.groupBy("stem").agg(F.count("*").alias("docs"), F.sum("k").alias("hits"))
    return members.groupBy("stem").agg(F.count("*").alias("forms")).join(found, "stem", "left").select("stem", "forms", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("hits", F.lit(0)).alias("hits"))


def tipped(docs: DataFrame, members: DataFrame, known: DataFrame, fires: int = 2, split: str = r"\n[ \t]*\n") -> DataFrame:
    """stem, paragraphs: how many paragraphs come to `fires` uses with a family's words that the `known` words (word) alone don't bring there.

    Only paragraphs that the known words leave open are looked at word by word; of the others a number is shuffled.
    """
    members, known = _sent(members), _sent(known.select("word").distinct().withColumn("had", F.lit(1)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.split("text", split, -1).alias("p"))
    paragraphs = rows.select("row", F.posexplode_outer("p").alias("at", "p")).where("p is not null")
    had = _uses(paragraphs, "p", "row", "at").join(known, "word", "left").groupBy("row", "at").agg(F.count("had").alias("had")).where(F.col("had") < fires)
    open_ = cut(paragraphs.join(had, ["row", "at"]))
    new = _uses(open_, "p", "row", "at", "had").join(members, "word").groupBy("stem", "row", "at", "had").agg(F.count("*").alias("k"))
    return new.where(F.col("had") + F.col("k") >= fires).groupBy("stem").agg(F.count("*").alias("paragraphs"))


def carried(found: DataFrame, previous: DataFrame) -> DataFrame:
    """stem, lift, status, note, stale: families (stem, lift) with the status and note of their last review (stem, lift, status, note).

    New ones are pending. Reviewed ones that are not found again are kept as stale; pending ones are let go.
    """
    old = previous.select("stem", F.col("lift").alias("old_lift"), "status", "note")
    both = found.select("stem", "lift", F.lit(True).alias("here")).join(old, "stem", "full")
    kept = both.where("here or coalesce(status, 'pending') <> 'pending'")
    return kept.select("stem", F.coalesce("lift", "old_lift").alias("lift"), F.coalesce("status", F.lit("pending")).alias("status"), "note", F.col("here").isNull().alias("stale"))


def drift(shipped: DataFrame, derived: DataFrame) -> DataFrame:
    """key, shipped, derived of two summaries (key, value) where they differ; a null value and a missing key are alike. Keys must be unique."""
    a, b = shipped.select("key", F.col("value").alias("shipped")), derived.select("key", F.col("value").alias("derived"))
    return a.join(b, "key", "full").where(~F.col("shipped").eqNullSafe(F.col("derived")))
