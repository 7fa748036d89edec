"""One pass of a catalogue of terms over documents: findings with places, allowances and tolerance by register.

A catalogue is a table (id, term, band, priority, max_allowed). A term is one word or more, white space alone between them, and matches in any
ASCII case where no letter, apostrophe or hyphen adjoins it. A word-by-word trie of the whole catalogue goes to every task, so that a
document is read once however many terms there are; a catalogue beyond TERMS or TERM_BYTES is joined by hash to the
documents' runs of words instead, with equal results. Of matches of a band that overlap, the first counts, of those the longest, then the least id.

Places count tokens from 0: a token is a run of word characters (any beyond ASCII are), or of other characters without white space.
Null and empty texts have no findings. Repeated documents give theirs each. Repeated rows of a catalogue count once. A null term, id or band is left
out; a null max_allowed allows none. Extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import WORD_LETTERS

from .intervals import first_come

TERMS, TERM_BYTES = 200_000, 16 << 20
#: Words with their apostrophes and hyphens, and what stands between; the same in every engine.
TOKEN = rf"([{WORD_LETTERS}'-]+|[^{WORD_LETTERS}'\- \t\r\n\x0B\f]+)"
_TOKEN = re.compile("[0-9A-Za-z_\x80-\U0010ffff'-]+|[^0-9A-Za-z_\x80-\U0010ffff'\\- \t\r\n\x0b\f]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_END = ""  # no word: marks the terms that end at a node


def lower_ascii(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    """Tokens of a text, A-Z lower-cased."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(TOKEN), F.lit(1))


def trie(rows) -> dict:
    """Nested dictionaries by word; under _END the places of the terms in `rows`, lists of words."""
    root: dict = {}
    for i, words in enumerate(rows):
        node = root
        for w in words:
            node = node.setdefault(w, {})
        node.setdefault(_END, []).append(i)
    return root


def _matches(root, names):
    """Arrow batches (row, doc_id, register, text) to every match of the broadcast trie."""

    def run(batches):
        known = names.value
        for batch in batches:
            for row, doc, register, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = _TOKEN.findall((text or "").translate(_UPPER))
                places, starts, ends = [], [], []
                for start in range(len(found)):
                    node, at = root.value, start
                    while at < len(found) and (node := node.get(found[at])) is not None:
                        at += 1
                        for i in node.get(_END, ()):
                            places.append(i), starts.append(start), ends.append(at)
                columns = [pa.array([row] * len(places), pa.int64()), pa.array([doc] * len(places), pa.int64()), pa.array([register] * len(places), pa.string())]
                columns += [pa.array([known[i] for i in places], pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "register", "term", "start", "end"])

    return run


def matches(docs: DataFrame, catalogue: DataFrame, register: str | None = None, terms: int = TERMS, size: int = TERM_BYTES) -> DataFrame:
    """row, doc_id, register, term, start, end of every match, overlapping ones included; a row is a document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (F.col(register) if register else F.lit(None)).cast("string").alias("register"), F.col("text").cast("string").alias("text"))
    wanted = catalogue.where("term is not null and id is not null and band is not null").select("term").distinct().withColumn("words", tokens(F.col("term"))).where("size(words) > 0")
    n, held, longest = wanted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)), F.coalesce(F.max(F.size("words")), F.lit(0))).first()
    if n <= terms and held <= size:
        known = wanted.collect()
        context = docs.sparkSession.sparkContext
        return rows.mapInArrow(_matches(context.broadcast(trie(r.words for r in known)), context.broadcast([r.term for r in known])), "row long, doc_id long, register string, term string, start int, end int")
    t = rows.select("row", "doc_id", "register", tokens(F.col("text")).alias("t"))

    def runs_of(k: int) -> DataFrame:
        runs = F.transform(F.sequence(F.lit(1), F.size("t") - (k - 1)), lambda i: F.array_join(F.slice("t", i, k), " "))
        return t.where(F.size("t") >= k).select("row", "doc_id", "register", F.posexplode(runs).alias("start", "key"), F.lit(k).alias("k"))

    keyed = wanted.select("term", F.array_join("words", " ").alias("key"))
    every = runs_of(1)
    for k in range(2, longest + 1):
        every = every.unionByName(runs_of(k))
    return every.join(keyed, "key").select("row", "doc_id", "register", "term", "start", (F.col("start") + F.col("k")).alias("end"))


def scan(docs: DataFrame, catalogue: DataFrame, skips: DataFrame | None = None, register: str | None = None, **bounds: int) -> DataFrame:
    """doc_id, id, band, priority, pos, end, past: the findings of every document.

    skips (register, id) takes entries out of the catalogue for documents of a register, before overlaps are decided. past says whether
    the finding comes after the max_allowed first ones of its document and id.
    """
    entries = catalogue.where("term is not null and id is not null and band is not null").groupBy("id", "term", "band", "priority").agg(F.coalesce(F.max("max_allowed"), F.lit(0)).alias("max_allowed"))
    found = matches(docs, catalogue, register, **bounds).join(entries, "term")
    if skips is not None:
        found = found.join(skips.select("register", "id").distinct(), ["register", "id"], "left_anti")
    found = found.withColumn("wide", F.col("start") - F.col("end"))
    chosen = first_come(found, ["row", "band"], ["wide", "id", "priority", "term"]).where("chosen")
    place = F.row_number().over(Window.partitionBy("row", "id").orderBy("start", "end", "priority"))
    return chosen.select("doc_id", "id", "band", "priority", F.col("start").alias("pos"), "end", (place > F.col("max_allowed")).alias("past"))


def attributed(rules: DataFrame) -> DataFrame:
    """One rule for each term (in any ASCII case) of rules (term, origin, ...): that of the least origin, a child's before its parent's.

    Null terms are left out; of rules equal in term and origin the least by id is taken.
    """
    w = Window.partitionBy("__term").orderBy(F.col("origin").asc_nulls_last(), F.col("id").asc_nulls_last())
    keyed = rules.where("term is not null").withColumn("__term", lower_ascii(F.col("term"))).withColumn("__rn", F.row_number().over(w))
    return keyed.where("__rn = 1").drop("__rn", "__term")


def term_evidence(docs: DataFrame, catalogue: DataFrame, **bounds: int) -> DataFrame:
    """term, docs, hits of every term of the catalogue, those that no document holds included."""
    per_row = matches(docs, catalogue, **bounds).groupBy("term", "row").agg(F.count("*").alias("k"))
    found = per_row.groupBy("term").agg(F.count("*").alias("docs"), F.sum("k").alias("hits"))
    terms = catalogue.where("term is not null and id is not null and band is not null").select("term").distinct()
    return terms.join(found, "term", "left").select("term", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("hits", F.lit(0)).alias("hits"))
