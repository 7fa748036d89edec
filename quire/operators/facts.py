"""Facts of texts as arrays, one row in, one row out: dates, quotations, names. Null texts have null arrays, empty ones empty arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import WORD_LETTERS, bound, canonical_number

# The months.
MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "(" + "|".join(MONTHS) + ")"
#: Pattern and the groups that hold year, month and day.
SPELLINGS = ((rf"\b{_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}})\b", 3, 1, 2), (rf"\b(\d{{1,2}})\s+{_MONTH}\s+(\d{{4}})\b", 3, 2, 1), (r"\b(\d{4})-(\d{2})-(\d{2})\b", 1, 2, 3))
#: The same patterns, behind a look for a character that they can begin with.
_DATES = tuple(f"(?=[{first}]){pattern}" for first, (pattern, *_) in zip(("A-Z", "0-9", "0-9"), SPELLINGS))
QUOTED = r"\"([^\"]{0,400})\"|\u201c([^\u201d]{0,400})\u201d"
_NAME = rf"[A-Z][a-zA-Z0-9]*(?:[ -][A-Z][a-zA-Z0-9]*)*(?![{WORD_LETTERS}])"
#: A name after what begins a sentence or a list item, or (group 1) one anywhere else.
NAMES = rf"(?:^|[.!?:]\s+|\n\s*(?:[-*+>#]+\s*|\d+[.)]\s*)?){_NAME}|(?<![{WORD_LETTERS}])({_NAME})"

# Spellings of numbers, in the order in which they claim their places. Each looks first for a character that it can begin with.
_PLAIN, _GROUPED = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?", r"(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)"
ESCAPE = r"(?:%[0-9A-Fa-f]{2})+"
RANGE = rf"(?=[0-9])(?<![\w.,$-])({_PLAIN})(?:[-\u2013]|\s+to\s+)({_PLAIN})(?![0-9,])\s*(%|percent\b)?"
PERCENT = r"(?=[0-9])\b([0-9]+(?:\.[0-9]+)?)\s*(?:%|percent\b)"
VERSION = r"(?=[v0-9])(?<!\$)(?<!,)\bv?[0-9]+\.[0-9]+(?:\.[0-9]+)*\b"
ORDINAL = r"(?=[0-9])\b([0-9]+)(?:st|nd|rd|th)\b"
NUMBER = rf"(?=[-0-9])(?:(?:(?<=[\s(\[{{])|^)-?{_GROUPED}(?![\w,]|\.[0-9])|(?<![\w.,-]){_GROUPED}(?![\w,]|\.[0-9]))"


def dates(text: Column) -> Column:
    """Dates as year-month-day: those spelled month first, then day first, then in digits."""

    def of(pattern: str, year: int, month: int, day: int) -> Column:
        def iso(d: Column) -> Column:
            part = lambda g: F.regexp_extract(d, pattern, g)
            number = F.array_position(F.array(*map(F.lit, MONTHS)), part(month)).cast("int") if _MONTH in pattern else part(month).cast("int")
            return F.concat_ws("-", part(year), F.lpad(number.cast("string"), 2, "0"), F.lpad(part(day), 2, "0"))

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), iso)

    return F.concat(*(of(pattern, *groups) for pattern, (_, *groups) in zip(_DATES, SPELLINGS)))


def numbers(text: Column) -> Column:
    """Numbers in one spelling each: ranges, percentages, versions, ordinals, then all others, in order of place within a kind.

    Dates and percent escapes are no numbers, and what one kind has claimed the next ones don't see.
    """

    def span(s: Column) -> Column:
        part = lambda g: F.regexp_extract(s, RANGE, g)
        return F.concat(F.lit("range:"), canonical_number(part(1)), F.lit("-"), canonical_number(part(2)), F.when(part(3) != "", "%").otherwise(""))

    kinds = [
        (RANGE, span),
        (PERCENT, lambda s: F.concat(canonical_number(F.regexp_extract(s, PERCENT, 1)), F.lit("%"))),
        (VERSION, lambda s: F.concat(F.lit("version:"), F.regexp_replace(s, "^v", ""))),
        (ORDINAL, lambda s: canonical_number(F.regexp_extract(s, ORDINAL, 1))),
        (NUMBER, canonical_number),
    ]

    def claim(t: Column, left: list) -> Column:
        (pattern, spelled), *rest = left
        hits = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        if not rest:
            return F.transform(hits, spelled)
        left = lambda h: F.when(F.size(h) > 0, F.regexp_replace(t, pattern, " ")).otherwise(t)
        return bound(hits, lambda h: F.concat(F.transform(h, spelled), bound(left(h), lambda b: claim(b, rest))))

    masked = text
    for pattern in (*_DATES, ESCAPE):
        masked = F.regexp_replace(masked, pattern, " ")  # places don't matter here
    return F.when(text.isNotNull(), bound(masked, lambda t: claim(t, kinds)))


def quotes(text: Column, least: int = 4) -> Column:
    """Quotations of `least` words or more in straight or curly double quotes, white space collapsed, apostrophes straight."""
    spans = F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0))
    flat = F.transform(spans, lambda q: F.trim(F.regexp_replace(F.replace(F.substring(q, F.lit(2), F.length(q) - 2), F.lit("\u2019"), F.lit("'")), r"[ \t\r\n]+", " ")))
    return F.filter(flat, lambda q: F.size(F.split(q, " ")) >= least)


def names(text: Column) -> Column:
    """Runs of capitalised words that no beginning of a sentence explains, of two characters or more."""
    return F.filter(F.regexp_extract_all(text, F.lit(NAMES), F.lit(1)), lambda n: F.length(n) >= 2)


def fact_counts(docs: DataFrame) -> DataFrame:
    """Names of each document (doc_id, text): how many, how many different, and the first."""
    d = docs.select("doc_id", names(F.col("text")).alias("n"))
    return d.select("doc_id", F.size("n").alias("names"), F.size(F.array_distinct("n")).alias("different"), F.get("n", F.lit(0)).alias("first_name"))


def order_dates(orders: DataFrame) -> DataFrame:
    """Dates read back from a sentence that spells an order's date in three ways."""
    day = F.col("o_orderdate")
    said = F.concat(F.lit("Due "), F.date_format(day, "MMMM d, yyyy"), F.lit(", sent "), F.date_format(day, "d MMMM yyyy"), F.lit(" or "), F.date_format(day, "yyyy-MM-dd"), F.lit(". Not 1234-567."))
    return orders.select("o_orderkey", F.array_join(dates(said), " ").alias("dates"))


def quoted_texts(docs: DataFrame) -> DataFrame:
    """Quotations read back from a sentence that quotes each document whole, and from the document itself."""
    said = F.concat(F.lit('He said "'), F.col("text"), F.lit('" and "two words" and \u201cfour words  and\nit\u2019s all\u201d.'))
    return docs.select("doc_id", F.array_join(quotes(said), "|").alias("quotes"))


def lost_facts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Dates, quotations and names of the text before an edit that the text after it lacks, and the other way round, by doc_id.

    A row per document that both tables have, with six arrays. Rows that share a doc_id are paired all with all.
    """
    kinds = {"dates": dates, "quotes": quotes, "names": names}
    a = before.select("doc_id", *(f(F.col("text")).alias("a_" + k) for k, f in kinds.items()))
    b = after.select("doc_id", *(f(F.col("text")).alias("b_" + k) for k, f in kinds.items()))
    sides = [(F.array_sort(F.array_except(f"{x}_{k}", f"{y}_{k}"))).alias(f"{said}_{k}") for said, x, y in (("lost", "a", "b"), ("added", "b", "a")) for k in kinds]
    return a.join(b, "doc_id").select("doc_id", *sides)


def turn_facts(turns: DataFrame) -> DataFrame:
    """Names that an assistant's turn adds to or drops from the turn before it, as counts."""
    said = turns.where("role = 'assistant'").select("conv_id", "turn", "text")
    asked = turns.where("role <> 'assistant'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    t = said.join(asked, ["conv_id", "turn"]).select("conv_id", "turn", names(F.col("asked")).alias("a"), names(F.col("text")).alias("b"))
    return t.select("conv_id", "turn", F.size(F.array_except("a", "b")).alias("lost"), F.size(F.array_except("b", "a")).alias("added"))
