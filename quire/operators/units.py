"""Findings brought to the sentences and blocks of their documents: what a rewrite would work on, and what it can't.

Tasks cut texts into blocks and sentences with their places; findings meet them by windows (`asof`), in order of place, so that no
finding is compared with every sentence. Documents need unique doc_ids; findings of other documents, and those of null or empty texts, can't be
placed. Repeated findings count once each. Extra columns are ignored. Places count characters from 0, lines from 1.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import ABBREVIATIONS, CLOSERS

from .rounds import pieces

_BREAK = re.compile(r"(\n[ \t]*\n)")
_LIST_ITEM = re.compile(r"^\s*(?:[-*+]|[0-9]+[.)])\s")
_SPACE = " \t\r\n\x0b\f"
_HELD = re.compile(rf"(?<![0-9A-Za-z_\x80-\U0010ffff])((?i:{'|'.join(ABBREVIATIONS)})|[A-Z])\.")
_NUMBER, _ITEM = re.compile(rf"(?m)^[{_SPACE}]*([0-9]+)\."), re.compile(rf"(?m)^[ \t\r\x0b\f]*(?=[-*+][{_SPACE}]|[0-9]+\)[{_SPACE}]|[0-9]+\x01)")
_END = re.compile(rf"[.!?][{CLOSERS}]?[{_SPACE}]+")

#: Findings of these bands or ids are no matter of wording; those of whole documents have no place.
SKIPPED_BANDS, SKIPPED_IDS = ["safety", "structure"], ["hidden-unicode", "em-dash-rate", "suppression-invalid", "suppression-unused", "suppression-refused"]
WHOLE_IDS, BLOCK_IDS = ["low-diversity", "uniform-paragraphs"], ["tier2-cluster", "tier3-density"]


def blocks_of(text: str) -> list[tuple[int, int]]:
    """Places of the blocks between blank lines; those of white space alone are none."""
    out, at = [], 0
    for i, part in enumerate(_BREAK.split(text)):
        if i % 2 == 0 and part.strip(_SPACE):
            out.append((at, at + len(part)))
        at += len(part)
    return out


def sentences_of(text: str) -> list[tuple[int, int]]:
    """Places of the sentences of `functions.text.sentences`: same rules, without taking anything out.

    Periods that end nothing are masked by another character of the same width, so places stay.
    """
    masked = _HELD.sub(lambda m: m[0][:-1] + "\x01", text)
    masked = _NUMBER.sub(lambda m: m[0][:-1] + "\x01", masked)
    cuts = sorted({m.end() for m in _END.finditer(masked)} | {m.start() for m in _ITEM.finditer(masked)} | {0, len(text)})
    out = []
    for a, b in zip(cuts, cuts[1:]):
        body = text[a:b]
        start = a + len(body) - len(body.lstrip(_SPACE))
        end = a + len(body.rstrip(_SPACE))
        if start < end:
            out.append((start, end))
    return out


def is_prose(block: str) -> bool:
    """Whether a block is prose: no heading, quote, table, code or list, and less than half of it list items."""
    lines = [x for x in block.split("\n") if x.strip()]
    if not lines or lines[0].startswith(("    ", "\t")) or lines[0].lstrip().startswith(("#", ">", "|", "```")) or _LIST_ITEM.match(lines[0]):
        return False
    return 2 * sum(bool(_LIST_ITEM.match(x)) for x in lines) < len(lines)


def _cut(batches):
    """Arrow batches (doc_id, text) to blocks and their sentences."""
    for batch in pieces(batches):
        for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            rows = []
            for n, (start, end) in enumerate(blocks_of(text or "")):
                body = text[start:end]
                prose = is_prose(body)
                found = sentences_of(body) or [(0, len(body))]
                rows += [(n, start, start + len(body.rstrip()), end, prose, i, start + a, start + b, body[a:b]) for i, (a, b) in enumerate(found)]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 9, kinds)]
            yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), pa.int64()), *columns], ["doc_id", "block", "block_start", "block_end", "block_upto", "prose", "n", "start", "end", "sentence"])


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, block, block_start, block_end, block_upto, prose, n, start, end, sentence, before: every sentence with its place and block, and the sentence before it in its block."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = rows.mapInArrow(_cut, "doc_id long, block int, block_start int, block_end int, block_upto int, prose boolean, n int, start int, end int, sentence string")
    return cut.withColumn("before", F.coalesce(F.lag("sentence").over(Window.partitionBy("doc_id", "block").orderBy("n")), F.lit("")))


def asof(points: DataFrame, spans: DataFrame, keys: list[str], out: str = "span") -> DataFrame:
    """points (keys, start, ...) with `out`: of the spans (keys, start, ...) the last that begins at or before the point, as a struct, else null.

    One sweep over both tables in order of place; of spans with one start the last by their other columns is taken.
    """
    rest = [c for c in points.columns if c not in (*keys, out)]
    a = points.select(*keys, F.col("start").alias("__at"), F.lit(1).alias("__side"), F.struct(*rest).alias("__point"))
    b = spans.select(*keys, F.col("start").alias("__at"), F.lit(0).alias("__side"), F.struct(*(c for c in spans.columns if c not in keys)).alias("__span"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col("__at").asc_nulls_first(), "__side", "__span").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("__span", F.last(F.when(F.col("__at").isNotNull(), F.col("__span")), ignorenulls=True).over(w)).where("__side = 1")
    return swept.select(*keys, *(F.col("__point")[c].alias(c) for c in rest), F.col("__span").alias(out))


def _placed(batches):
    """Arrow batches (doc_id, text, findings) to each finding with the start of its nearest match and the place of its line, null if there is none."""
    for batch in pieces(batches):
        out = []
        for doc, text, findings in zip(*(c.to_pylist() for c in batch.columns)):
            text = text or ""
            low = text.lower()
            ends = [*(m.start() for m in re.finditer("\n", text)), len(text)]
            known: dict[str, list[int]] = {"": []}
            for f in findings:
                match, line = f["match"] or "", max(1, f["line"] or 1)
                if match not in known:
                    known[match] = _every(text, match) or _every(low, match.lower())
                start = min(known[match], key=lambda s: (abs(bisect_left(ends, s) + 1 - line), s), default=None)
                there = line <= len(ends)
                begin = (ends[line - 2] + 1 if line > 1 else 0) if there else None
                out.append((doc, f["id"], f["band"], f["line"], match, start, begin, ends[line - 1] if there else None))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        columns = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 8, kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "id", "band", "line", "match", "start", "line_start", "line_end"])


def _every(text: str, match: str) -> list[int]:
    return [m.start() for m in re.finditer(re.escape(match), text)]


def located(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """findings (doc_id, id, band, line, match) with `start`, the occurrence of match nearest to the line, and the line's own place.

    Of equally near occurrences the first is taken; an exact one goes before one in another case. The findings of a document travel to its
    text together.
    """
    fields = F.struct("id", "band", F.col("line").cast("int").alias("line"), F.col("match").cast("string").alias("match"))
    grouped = findings.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(fields).alias("findings"))  # of one document
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(grouped, "doc_id")
    schema = "doc_id long, id string, band string, line int, match string, start int, line_start int, line_end int"
    return rows.select("doc_id", "text", "findings").mapInArrow(_placed, schema)


def plan(docs: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, rest) of findings (doc_id, id, band, line, match).

    units: doc_id, kind, start, end, text, before, ids: a sentence with all its findings (kind span), or a whole block for findings about
    passages (kind block), with the sentence before a span; spans within a block that is a unit are left to it. rest: doc_id, id, line, reason.
    Findings of SKIPPED_BANDS and SKIPPED_IDS are in neither.
    """
    wanted = findings.where(~F.coalesce(F.col("band"), F.lit("")).isin(SKIPPED_BANDS) & ~F.coalesce(F.col("id"), F.lit("")).isin(SKIPPED_IDS))
    of_whole = F.coalesce(F.col("id").isin(WHOLE_IDS), F.lit(False))
    whole = wanted.where(of_whole).select("doc_id", "id", F.col("line").cast("int").alias("line"), F.lit("of the whole document").alias("reason"))
    passage = F.coalesce(F.col("id").isin(BLOCK_IDS), F.lit(False))
    placed = located(docs, wanted.where(~of_whole)).withColumn("kind", F.when(passage, "block").otherwise("span")).withColumn("start", F.when(passage, F.col("line_end")).otherwise(F.col("start")))
    # A block's first sentence stands for all of the block that lies before it.
    cut = sentences(docs).withColumn("sentence_start", F.col("start")).withColumn("start", F.when(F.col("n") == 0, F.col("block_start")).otherwise(F.col("start")))
    found = asof(placed, cut.drop("sentence"), ["doc_id"])
    inside = F.when(F.col("kind") == "block", F.col("line_start")).otherwise(F.col("start")) < F.col("span.block_upto")
    missing = F.when(F.col("start").isNull(), "not in the text").when(~F.coalesce(inside, F.lit(False)), "in no block").when(~F.col("span.prose"), "in a list, table, heading or code block")
    found = found.withColumn("reason", missing)
    rest = whole.unionByName(found.where("reason is not null").select("doc_id", "id", "line", "reason"))
    sentence = (F.col("kind") == "span") & F.col("start").between(F.col("span.sentence_start"), F.col("span.end") - 1)
    pick = lambda a, b: F.when(sentence, F.col(a)).otherwise(b)
    units = found.where("reason is null").select(
        "doc_id", "kind", "id", pick("span.sentence_start", F.col("span.block_start")).alias("start"), pick("span.end", F.col("span.block_end")).alias("end"), pick("span.before", F.lit("")).alias("before"), "span.block"
    )
    claimed = F.max((F.col("kind") == "block").cast("int")).over(Window.partitionBy("doc_id", "block"))
    units = units.withColumn("claimed", claimed).where("kind = 'block' or claimed = 0")
    units = units.groupBy("doc_id", "kind", "start", "end", "before").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # of one sentence or block
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("whole"))
    text = F.substring(F.col("whole"), F.col("start") + 1, F.col("end") - F.col("start"))
    return units.join(texts, "doc_id").select("doc_id", "kind", "start", "end", text.alias("text"), "before", "ids"), rest
