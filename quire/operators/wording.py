"""Findings of controlled language, line by line: one row (doc_id, id, line, match) for each, lines from 1.

Null and empty texts have none; repeated rows give theirs as they come; columns beyond doc_id and text are ignored. An -ing word makes a clause if the next word
begins like one of AFTER_ING ("doing well" begins like "we").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import markdown as M

# Banned modals and verbs, words after an -ing form that make it a clause, -ing words that are no verbs, commands.
MODALS = "should would may might could".split()
VERBS = "check verify confirm ensure".split()
MONTH_BEFORE = "in of by until since before after during late early mid".split()
AFTER_ING = (
    "that you we they the this these a an to not it them him her us me be been being get gets got make makes made have has had do does did "
    "will would can could should may might must"
).split()
NO_VERBS = "including following according something nothing anything everything morning evening".split()
COMMANDS = (
    "do run set check make install start stop open close write read delete remove add update create build compile deploy execute launch send receive "
    "fetch pull push configure adjust increase decrease connect disconnect log login logout authenticate verify confirm ensure"
).split()
EMPHASIS = r"\b(?:IMPORTANT|CRITICAL|NEVER|ALWAYS|WARNING|MUST(?: NOT)?|DO NOT)\b"
#: Non-blank lines and characters that call for a note (P2) or a cut (P1).
LINES, CHARACTERS = (300, 600), (32_000, 40_000)


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


#: `May` as a month: before a day or a year, or after a word of time.
MONTHS = ((r"\bMay([ \t]+[0-9])", "   $1"), (rf"\b((?i:{'|'.join(MONTH_BEFORE)})[- ])May\b", "$1   "))
MODAL = rf"(?i)\b({_any(MODALS)})\b"
VERB = rf"(?i)\b({_any(VERBS)})\b"
ING = rf"(?i),\s+([a-z]+ing)\s+{_any(AFTER_ING)}"
CONDITION = rf"(?i)(?:^|[.!?] {{1,2}}|: )(?:[-*]\s+|[0-9]+\.\s+)?({_any(COMMANDS)}\b[^.!?\n]*?\b(?:if|when|unless)\b)"
STATE = r"(?i)\b(?:is|are|was|were|has been|have been|will be)\b"


def _found(line: Column, pattern: str) -> Column:
    return F.regexp_extract_all(line, F.lit(pattern), F.lit(1))


def line_findings(line: Column) -> Column:
    """Array of (id, match) of one line."""
    dated = line
    for pattern, masked in MONTHS:
        dated = F.regexp_replace(dated, pattern, masked)
    kinds = {
        "modal": _found(dated, MODAL),
        "ing-clause": F.filter(_found(line, ING), lambda w: ~F.lower(w).isin(NO_VERBS)),
        "condition-last": F.filter(_found(line, CONDITION), lambda m: ~m.rlike(STATE)),
        "banned-verb": _found(line, VERB),
        "semicolon": F.when(F.contains(F.regexp_replace(line, M.ENTITY, ""), F.lit(";")), F.array(F.lit(";"))).otherwise(F.array().cast("array<string>")),
    }

    def named(kind: str, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("id"), m.alias("match")))

    return F.concat(*(named(k, found) for k, found in kinds.items()))


def wording(docs: DataFrame) -> DataFrame:
    """All findings of the texts' lines."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "text_line"))
    found = lines.select("doc_id", (F.col("at") + 1).alias("line"), F.explode(line_findings(F.col("text_line"))).alias("f"))
    return found.select("doc_id", "f.id", "line", "f.match")


def size_bands(docs: DataFrame) -> DataFrame:
    """Non-blank lines, characters and emphasised lines (code masked) of each text, and whether each is over its bounds.

    Emphasis may take eight lines or a tenth of the non-blank ones. Null texts have nulls.
    """
    filled = lambda t: F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"\S"))
    band = lambda c, limits: F.when(F.col(c) > limits[1], "P1").when(F.col(c) > limits[0], "P2")
    copy = filled(M.prose_copy(F.col("text")))
    d = docs.select("doc_id", F.size(filled(F.col("text"))).alias("lines"), F.length("text").alias("characters"), copy.alias("copy"))
    d = d.withColumn("emphasised", F.size(F.filter("copy", lambda x: x.rlike(EMPHASIS)))).withColumn("allowed", F.greatest(F.lit(8), F.floor(F.size("copy") / 10).cast("int")))
    return d.select("doc_id", "lines", "characters", "emphasised", band("lines", LINES).alias("line_band"), band("characters", CHARACTERS).alias("character_band"), (F.col("emphasised") > F.col("allowed")).alias("over_emphasis"))


def excess(docs: DataFrame) -> DataFrame:
    """Documents of `size_bands` with any bound passed."""
    return size_bands(docs).where("line_band IS NOT NULL OR character_band IS NOT NULL OR over_emphasis")
