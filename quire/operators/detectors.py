"""Finding detectors: rows (doc_id, id, band, priority, pos, n) raised by rules over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def long_paragraphs(docs: DataFrame, most: int = 6) -> DataFrame:
    """Paragraphs (here: lines) of more than `most` sentences, with their place among the document's paragraphs."""
    # Counted before they are cut into rows: a filter on a row's count would compute it twice, and so would explode without outer.
    counts = F.transform(F.split("text", "\n"), lambda p: F.size(T.sentences(p)))
    return docs.select("doc_id", F.posexplode_outer(counts).alias("pos", "n")).where(F.col("n") > most)


def long_sentences(docs: DataFrame, most: int = 25, allowance: int = 6) -> DataFrame:
    """Sentences of more than `most` words after the first `allowance` of them in a document."""
    counts = F.transform(T.sentences(F.col("text")), lambda s: F.size(T.words(s)))
    s = docs.select("doc_id", F.posexplode_outer(counts).alias("pos", "n"))
    s = s.where(F.col("n") > most).withColumn("hit", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    return s.where(F.col("hit") > allowance).select("doc_id", "pos", "n", "hit")


# How comments to build steps begin; they are explained however long they are.
BUILD_MARKER = (
    r"(?i)^\s*(?:/{2}\s*|#\s*)?(?:(?:begin|end|start|stop)\b|[\w.:@/-]+[:-](?:start|end|begin|stop)\b|(?:todo|fixme|hack|xxx)\b|[\w-]+-allow\b"
    r"|prettier-ignore|markdownlint|eslint|stylelint|shellcheck|doctoc|all-contributors|mcp-name|sponsors?|omit\s+in\s+toc|toc\b|[\w-]+-(?:ignore|disable)[\w-]*)"
)


def concealed_spans(pages: DataFrame, least: int = 8) -> DataFrame:
    """Comments of each page with their words; unexplained from `least` words on if they are no build marker.

    Null and empty pages have no spans; repeated rows give theirs as they come.
    """
    c = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<!--(.*?)-->"), F.lit(1))).alias("pos", "span"))
    n = F.size(F.filter(F.split("span", r"[ \t\r\n]+"), lambda x: x != ""))
    return c.select("page_id", "pos", n.alias("words"), ((n >= least) & ~F.col("span").rlike(BUILD_MARKER)).alias("unexplained"))


def page_text(pages: DataFrame) -> DataFrame:
    """Text of each page: digest, characters, words."""
    t = pages.select("page_id", T.html_text(F.col("html")).alias("t"))
    return t.select("page_id", F.sha2("t", 256).alias("text_sha"), F.length("t").alias("chars"), F.size(F.filter(F.split("t", r"[ \n]+"), lambda x: x != "")).alias("words"))


def findings(docs: DataFrame) -> DataFrame:
    """The long-paragraph and long-sentence findings in one table."""
    a = long_paragraphs(docs).select("doc_id", F.lit("long-paragraph").alias("id"), F.lit("structure").alias("band"), F.lit("P2").alias("priority"), "pos", "n")
    b = long_sentences(docs).select("doc_id", F.lit("long-sentence").alias("id"), F.lit("clarity").alias("band"), F.lit("P1").alias("priority"), "pos", "n")
    return a.unionByName(b)


def finding_rollup(docs: DataFrame, top: int = 4) -> DataFrame:
    """Per band and priority, with totals: findings, documents, and how many a report shows at `top` per document and id."""
    f = findings(docs)
    f = f.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("pos")))
    g = f.groupBy("band", "priority", "doc_id").agg(F.count("*").alias("n"), F.sum((F.col("rn") <= top).cast("int")).alias("shown"))
    r = g.rollup("band", "priority").agg(F.sum("n").alias("findings"), F.count_distinct("doc_id").alias("docs"), F.sum("shown").alias("shown"))
    return r.select(F.coalesce("band", F.lit("all")).alias("band"), F.coalesce("priority", F.lit("all")).alias("priority"), "findings", "docs", "shown")
