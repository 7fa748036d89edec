"""Tables of contents and headings by lines: gaps and islands over each document's lines.

Lines count from 1. Documents are rows: repeated rows give theirs each. Null texts have no lines. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.markdown import FENCE, FRONTMATTER, blank_all

#: Lines that end in a page number which make a table, how near the top it begins, and where looking ends.
LEAST, TOP, LIMIT = 5, 80, 200
PAGE = r"[^\s.].*?[\s.]{2,}[0-9]{1,4}\s*$"
#: What every such line ends in, found in one pass where the whole pattern tries each beginning.
PAGE_END = r"[\s.]{2}[0-9]{1,4}\s*$"


def _lines(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """row, doc_id, at, line of all lines, or the first `limit` ones."""
    lines = F.split("text", "\n", -1)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")  # numbered before they are cut
    return rows.select("row", "doc_id", F.posexplode_outer(lines if limit is None else F.slice(lines, 1, limit)).alias("at", "line")).where("line is not null")


def contents(docs: DataFrame, least: int = LEAST, top: int | None = TOP, limit: int | None = LIMIT) -> DataFrame:
    """doc_id, first, last: the first run of `least` lines or more that end in a page number, if it begins in the first `top` lines.

    Without `top` it may begin anywhere, and without `limit` texts are read to their end.
    """
    paged = _lines(docs, limit).where(F.col("line").rlike(PAGE_END) & F.col("line").rlike(PAGE))
    island = F.col("at") - F.row_number().over(Window.partitionBy("row").orderBy("at"))
    runs = paged.withColumn("island", island).groupBy("row", "doc_id", "island").agg(F.min("at").alias("first"), F.count("*").alias("n")).where(F.col("n") >= least)
    if top is not None:
        runs = runs.where(F.col("first") < top)
    return runs.groupBy("row", "doc_id").agg(F.min(F.struct("first", "n")).alias("x")).select("doc_id", (F.col("x.first") + 1).alias("first"), (F.col("x.first") + F.col("x.n")).alias("last"))


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, line, kind, title, upto: markdown headings of three levels, marked or underlined, outside code, and where their sections end.

    A heading of level one or underlined with = is a chapter, others are sections; deeper ones are none. A section ends before the next heading.
    """
    clean = docs.withColumn("text", blank_all(F.col("text"), FRONTMATTER, FENCE))
    w = Window.partitionBy("row").orderBy("at")
    x = _lines(clean).withColumn("next", F.coalesce(F.regexp_replace(F.lead("line").over(w), r"^\s+|\s+$", ""), F.lit(""))).withColumn("size", F.count("*").over(Window.partitionBy("row")))
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    mark = F.regexp_extract(line, r"^(#{1,6})\s+\S", 1)
    under = F.when((line != "") & (mark == "") & F.col("next").rlike("^=={1,}$"), "chapter").when((line != "") & (mark == "") & F.col("next").rlike("^--{1,}$"), "section")
    kind = F.when(mark == "#", "chapter").when((mark != "") & (F.length(mark) <= 3), "section").otherwise(under)
    title = F.when(mark != "", F.regexp_replace(line, r"^#{1,6}\s+|\s+#*$", "")).otherwise(line)
    found = x.select("row", "doc_id", "at", "size", kind.alias("kind"), title.alias("title")).where("kind is not null")
    end = F.coalesce(F.lead("at").over(w), F.col("size"))
    return found.select("doc_id", (F.col("at") + 1).alias("line"), "kind", "title", end.alias("upto"))
