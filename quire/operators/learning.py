"""What an edit says about its author: a text before and after, word for word and sentence for sentence.

Pairs are the consecutive turns of a conversation (conv_id, turn, text). Null texts have no words; a turn whose next one is null is compared with an empty text.
Turns without a next one are no pair. Repeated turns (equal conv_id and turn) are ordered by text. Extra columns are ignored.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import markdown as M
from quire.functions import text as T

#: Times that a change must repeat to be proposed, and letters of a word that counts as content.
REPEATS, LETTERS = 2, 4


def turn_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, turn, before, after: each turn's text beside that of the next turn of its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    after = F.lead(F.struct(F.coalesce("text", F.lit("")).alias("text"))).over(w)
    return turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("before"), after.alias("next")).where("next is not null").select("conv_id", "turn", "before", F.col("next.text").alias("after"))


def replaced(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """Words of a that stand, one for one, where b has another; matching blocks are the longest ones first, memory follows the longer list."""
    return [(a[i], b[j]) for tag, i, i2, j, j2 in SequenceMatcher(None, a, b).get_opcodes() if tag == "replace" and i2 - i == j2 - j == 1]


def _replacements(batches):
    """Arrow batches (row, before, after) of word lists to (row, old, new)."""
    for batch in batches:
        rows, olds, news = [], [], []
        for row, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            for old, new in replaced(a, b):
                rows.append(row), olds.append(old), news.append(new)
        kind = batch.schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(rows, kind), pa.array(olds, pa.string()), pa.array(news, pa.string())], ["row", "old", "new"])


def substitutions(turns: DataFrame) -> DataFrame:
    """conv_id, turn, old, new, n: content words that the next turn has replaced by another, one for one."""
    pairs = turn_pairs(turns).select(F.struct("conv_id", "turn").alias("row"), T.words(F.col("before")).alias("before"), T.words(F.col("after")).alias("after"))
    found = pairs.mapInArrow(_replacements, f"row {pairs.schema['row'].dataType.simpleString()}, old string, new string")
    return found.where(~F.col("old").isin(T.MARKERS)).groupBy("row", "old", "new").agg(F.count("*").alias("n")).select("row.conv_id", "row.turn", "old", "new", "n")


def removals(turns: DataFrame) -> DataFrame:
    """conv_id, turn, word, n: content words of LETTERS or more letters that the next turn has nowhere, with their uses before."""
    gone = F.filter(T.words(F.col("before")), lambda w: (F.length(w) >= LETTERS) & ~F.array_contains("kept", w) & ~w.isin(T.MARKERS))
    pairs = turn_pairs(turns).withColumn("kept", F.array_distinct(T.words(F.col("after"))))
    return pairs.select("conv_id", "turn", F.explode(gone).alias("word")).groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n"))


def opener_changes(turns: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """conv_id, turn, opener, before, after: first words of sentences whose number moved by `repeats` or more."""

    def openers(column: str) -> F.Column:
        first = lambda s: F.lower(F.regexp_extract(s, "([A-Za-z][A-Za-z'-]*)", 1))
        return F.filter(F.transform(T.sentences(M.prose(F.col(column))), first), lambda w: w != "")

    pairs = turn_pairs(turns)
    sides = [pairs.select("conv_id", "turn", F.explode(openers(c)).alias("opener"), F.lit(int(c == "before")).alias("b"), F.lit(int(c == "after")).alias("a")) for c in ("before", "after")]
    counts = sides[0].unionByName(sides[1]).groupBy("conv_id", "turn", "opener").agg(F.sum("b").alias("before"), F.sum("a").alias("after"))
    return counts.where(F.abs(F.col("before") - F.col("after")) >= repeats)


def measure_moves(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, measure, before, after, mean, toward: how each measure moved, and whether toward the mean of the role's turns."""
    from .stylometry import long_measures

    named = turns.select(F.struct("conv_id", "turn").alias("doc_id"), F.col("role").alias("source"), "text")
    m = long_measures(named)
    means = m.groupBy("source", "measure").agg(F.avg("value").alias("mean"))
    following = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turns.select("conv_id", "turn", F.col("role").alias("source"), following.alias("next")).where("next is not null")
    before = m.select("doc_id.conv_id", "doc_id.turn", "measure", F.col("value").alias("before"))
    after = m.select("doc_id.conv_id", F.col("doc_id.turn").alias("next"), "measure", F.col("value").alias("after"))
    moved = pairs.join(before, ["conv_id", "turn"]).join(after, ["conv_id", "next", "measure"]).join(means, ["source", "measure"])
    toward = F.abs(F.col("after") - F.col("mean")) < F.abs(F.col("before") - F.col("mean"))
    return moved.select("conv_id", "turn", F.col("source").alias("role"), "measure", "before", "after", F.round("mean", 4).alias("mean"), toward.alias("toward"))


def proposals(turns: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """conv_id, turn, kind, word, other, n: what repeats often enough to become a rule, substitutions and removals."""
    s = substitutions(turns).where(F.col("n") >= repeats).select("conv_id", "turn", F.lit("substitution").alias("kind"), F.col("old").alias("word"), F.col("new").alias("other"), "n")
    r = removals(turns).where(F.col("n") >= repeats).select("conv_id", "turn", F.lit("removal").alias("kind"), "word", F.lit(None).cast("string").alias("other"), "n")
    return s.unionByName(r)
