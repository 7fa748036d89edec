"""Profiles of rules that inherit from one another, blends of two, and their rules on documents.

A rule is a row (profile, kind, key, value, ord). Kinds that are lists take the lower-cased term as key, those by id the id, nested ones their path, and pairs
their canonical JSON (`canonical`), so that one overlay serves all: of the rules of a key the nearest profile's counts, within a profile the
last; the rule stands where its key stood first, the farthest profile's rules first. Null profiles, kinds or keys are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

from .closure import reached

DEPTH = 8

# Settings from strict to loose, caps of which the smaller is stricter, and what stands for no opinion.
STRICTNESS = {
    "em_dash": ["forbid", "limit", "allow"], "double_hyphen": ["forbid", "allow"], "semicolon": ["forbid", "allow"], "emoji": ["forbid", "allow"],
    "curly_quotes": ["forbid", "allow"], "one_word_sentence": ["forbid", "allow"],
}
CAPS = ["max_paragraph_sentences", "max_avg_sentence_words", "max_sentence_words", "max_em_dashes_per_1000w"]
NO_OPINION = {"oxford_comma": "allow", "date_format": "any"}


def canonical(json: Column) -> Column:
    """A flat JSON object of strings with its keys in order; other texts as they are."""
    entries = F.map_entries(F.from_json(json, "map<string,string>"))
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(entries))), json)


def lineage(parents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(profile, origin, hop): each profile of parents (profile, parent) with all it inherits from; itself is not among them.

    A profile that inherits from itself, or from more than `depth` profiles in a row, is an error.
    """
    edges = parents.where("parent is not null").select(F.col("profile").alias("src"), F.col("parent").alias("dst"))
    found = reached(edges, depth + 1)
    bad = found.where((F.col("root") == F.col("node")) | (F.col("hop") > depth)).select("root").first()
    if bad:
        raise ValueError(f"profile {bad.root} inherits in a loop or from more than {depth} profiles in a row")
    return found.select(F.col("root").alias("profile"), F.col("node").alias("origin"), "hop")


def inherited(rules: DataFrame, parents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """profile, kind, key, value, origin, place of every profile's rules with those that it inherits; place counts from 1 within a kind."""
    own = rules.where("profile is not null and kind is not null and key is not null").select(F.col("profile").alias("origin"), "kind", "key", "value", "ord")
    names = own.select(F.col("origin").alias("profile")).unionByName(parents.where("profile is not null").select("profile")).distinct()
    lines = lineage(parents, depth).unionByName(names.select("profile", F.col("profile").alias("origin"), F.lit(0).alias("hop")))
    every = lines.join(own, "origin")
    nearest = F.min_by(F.struct("value", "origin"), F.struct("hop", (-F.col("ord")).alias("last")))
    merged = every.groupBy("profile", "kind", "key").agg(nearest.alias("x"), F.min(F.struct((-F.col("hop")).alias("far"), "ord")).alias("first"))
    place = F.row_number().over(Window.partitionBy("profile", "kind").orderBy("first.far", "first.ord", "key"))  # of one profile's rules
    return merged.select("profile", "kind", "key", "x.value", "x.origin", place.alias("place"))


def blended(mechanics: DataFrame, left: str, right: str, weight: float = 0.5) -> DataFrame:
    """key, value, conflict: one setting of each key of the mechanics (profile, key, value) of two profiles.

    The stricter side counts, the smaller cap, or the side with an opinion; otherwise that of more weight (left at a half), as a conflict.
    """
    a = mechanics.where(F.col("profile") == left).select("key", F.col("value").alias("l"))
    b = mechanics.where(F.col("profile") == right).select("key", F.col("value").alias("r"))
    rank = lambda c: F.coalesce(*(F.when((F.col("key") == k) & (c == v), i) for k, order in STRICTNESS.items() for i, v in enumerate(order)), F.lit(9))
    ours = F.col("l") if weight >= 0.5 else F.col("r")
    opinion = lambda c: F.coalesce(*(F.when(F.col("key") == k, c == v) for k, v in NO_OPINION.items()), F.lit(False))
    low, high = F.col("l").try_cast("double"), F.col("r").try_cast("double")
    cap = F.when(low.isNull() | high.isNull(), ours).when(low <= high, F.col("l")).otherwise(F.col("r"))
    value = (
        F.when(F.col("l").isNull(), F.col("r")).when(F.col("r").isNull() | (F.col("l") == F.col("r")), F.col("l")).when(F.col("key").isin(CAPS), cap)
        .when(F.col("key").isin(list(STRICTNESS)), F.when(rank(F.col("l")) <= rank(F.col("r")), F.col("l")).otherwise(F.col("r")))
        .when(opinion(F.col("l")), F.col("r")).when(opinion(F.col("r")), F.col("l")).otherwise(ours)
    )
    settled = F.col("key").isin(CAPS + list(STRICTNESS)) | opinion(F.col("l")) | opinion(F.col("r"))
    conflict = F.col("l").isNotNull() & F.col("r").isNotNull() & (F.col("l") != F.col("r")) & ~settled
    return a.join(b, "key", "full").select("key", value.alias("value"), F.coalesce(conflict, F.lit(False)).alias("conflict"))


def ban_hits(docs: DataFrame, effective: DataFrame, register: str, kind: str = "banned") -> DataFrame:
    """doc_id, key, origin, hits: uses of the words that a document's profile (its column `register`) bans, with the profile that says so."""
    used = docs.select("doc_id", F.col(register).alias("profile"), F.explode(T.words(F.col("text"))).alias("key")).groupBy("profile", "key", "doc_id").agg(F.count("*").alias("hits"))
    return used.join(effective.where(F.col("kind") == kind).select("profile", "key", "origin"), ["profile", "key"]).select("doc_id", "key", "origin", "hits")
