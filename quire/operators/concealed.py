"""Text that a reader does not see, and text addressed to an agent: spans, claims and findings over pages or documents.

Tasks locate spans in whole texts (elements are closed by running depth); which spans claim others, and which instructions stand
in the open, is decided by windows over the located rows (`intervals`). Nothing but spans is shuffled.

Null and empty texts have no spans. Repeated rows give theirs as they come, each for itself. Columns beyond the id and the text are
ignored. Places count characters from 0, lines from 1.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detectors import BUILD_MARKER
from .hidden import hidden_messages
from .intervals import contained, covered, outermost
from .rounds import pieces

# Styles that take an element out of sight, the attribute that does, and white text.
_ZERO = r"0(?!\.\d*[1-9])"
HIDING = [
    r"display\s*:\s*none", r"visibility\s*:\s*hidden", rf"opacity\s*:\s*{_ZERO}", rf"font-size\s*:\s*{_ZERO}", r"(?:left|top)\s*:\s*-\d{3,}\s*px",
    r"text-indent\s*:\s*-\d{3,}\s*px", r"clip-path\s*:\s*inset\s*\(\s*100\s*%", r"clip\s*:\s*rect\s*\(\s*0\b", rf"transform\s*:\s*scale\s*\(\s*{_ZERO}",
    r"(?:width|height)\s*:\s*0(?:px)?(?=[;\"'\s]|$)",
]
HIDDEN = r"\shidden(?:\s*=\s*[\"']?(?:hidden|until-found)?[\"']?)?(?=[\s/>])"
WHITE = r"color\s*:\s*(?:white\b|#fff\b|#ffffff\b|#fefefe\b|#fdfdfd\b|rgba?\(\s*255\s*,\s*255\s*,\s*255)"

_STYLED = rf"(?is)<(?P<tag>\w+)[^>]*style=[\"'][^\"']*(?:{'|'.join(HIDING)})[^\"']*[\"'][^>]*"
#: Elements by the opening tag: kind, pattern, a word that the text must hold, and whether elements of the same name nest within.
ELEMENTS = [
    ("hidden element", _STYLED + r"?(?P<alone>/)?>", "style", True),
    ("hidden element", rf"(?is)<(?P<tag>\w+)[^>]*{HIDDEN}[^>]*>", "hidden", False),
    ("white text", rf"(?is)<(?P<tag>\w+)[^>]*style=[\"'](?![^\"']*background)[^\"']*{WHITE}[^\"']*[\"'][^>]*>", "style", False),
    ("white text", r"(?is)<(?P<tag>font)[^>]+color\s*=\s*[\"']?(?:white\b|#fff\b|#ffffff\b)[^>]*>", "font", False),
]
#: Spans of one match: kind, pattern, a word that the text must hold. What is hidden is the group, or all of it.
SPANS = [
    ("hidden element", _STYLED + ">", "style"),
    ("hidden element", rf"(?is)<\w+[^>]*{HIDDEN}[^>]*>", "hidden"),
    ("link title", r"(?s)\]\([^)\s]+\s+[\"'](?P<hidden>[^\"']+)[\"']\s*\)", "]("),
    ("reference title", r"(?m)^\s*\[[^\]]+\]:\s*\S+\s+[\"'](?P<hidden>[^\"']+)[\"']", "]:"),
    ("title attribute", r"(?i)title=[\"'](?P<hidden>[^\"']+)[\"']", "title="),
    ("image alt text", r"!\[(?P<hidden>[^\]]*)\]", "!["),
]
PROSE_KINDS = ("comment", "hidden element", "white text")
LEAST_WORDS = 8

# How instructions to an agent are put.
_EARLIER = r"(?:previous|above|prior|earlier|preceding)"
_RULES = r"(?:instructions|instruction|prompts|prompt|rules|rule"
DIRECTIVES = [
    rf"ignore\s+(?:all\s+|the\s+|any\s+)?{_EARLIER}\s+(?:instruction|instructions|prompt|prompts|rule|rules)",
    rf"disregard\s+(?:the\s+|all\s+|any\s+)?{_EARLIER}",
    rf"forget\s+(?:all\s+|everything\s+|any\s+|the\s+)*{_EARLIER}(?:\s+{_RULES}|context))?",
    r"forget\s+(?:all\s+|everything\s+)?(?:you|your)\s+(?:\w+\s+){0,2}?(?:told|instructed|taught|given|said|read|know|knew|learned)",
    rf"forget\s+(?:all\s+)?(?:your|the)\s+{_RULES}|training|system)",
    r"^\s*(?:system|assistant)\s*:", r"<\|im_(?:start|end)\|>", r"\[/?INST\]", r"\bsystem\s+prompt\s*:", r"\byou\s+are\s+now\b", r"\bnew\s+instructions?\s*:",
    r"</?function_calls>", r"<invoke\b", r"```\s*tool_code",
    r"do\s+not\s+(?:tell|inform|mention|reveal|show|report)\s+(?:it\s+|this\s+|that\s+)?(?:to\s+)?(?:the\s+)?(?:user|human|anyone|reader|operator|owner)",
    r"send\s+(?:this|these|the\s+(?:contents?|key|token|secret|password))\s+to\b",
    r"repl(?:y|ies)\s+(?:only\s+)?with\s+(?:the\s+|your\s+|this\s+)?(?:contents?|text|following|api|key|token|secret|password|system|nothing)",
    r"(?:^|[.!?]\s+|>\s*)(?:AI|assistant|model|agent|LLM|Claude|ChatGPT|GPT|Copilot|Gemini|system)\s*[,:]\s*(?:please\s+)?"
    r"(?:ignore|disregard|forget|stop|output|print|reveal|send|execute|run|respond|reply|write|do)\b",
]
_DIRECTIVE = re.compile("(?im)" + "|".join(DIRECTIVES))
_MARKER = re.compile(BUILD_MARKER)
_COMPILED = [(kind, re.compile(p), word, nests) for kind, p, word, nests in ELEMENTS], [(kind, re.compile(p), word) for kind, p, word in SPANS]

_ROW = [("place", pa.int32()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("line", pa.int64()), ("words", pa.int64()), ("directive", pa.bool_()), ("unexplained", pa.bool_())]
_SCHEMA = "row long, id string, place int, kind string, start long, end long, line long, words long, directive boolean, unexplained boolean"


def closings(text: str, name: str) -> tuple[dict[int, int], list[int], list[int]]:
    """Of the elements of a name: the end of the closing tag of each opening one by its start, by depth; starts and ends of all closing tags."""
    by_open, starts, ends, open_ = {}, [], [], []
    for m in re.finditer(rf"(?is)<(?:(/){re.escape(name)}\s*|{re.escape(name)}\b[^>]*?(/)?)>", text):
        if m[1]:
            starts.append(m.start())
            ends.append(m.end())
            if open_:
                by_open[open_.pop()] = m.end()
        elif not m[2]:
            open_.append(m.start())
    return by_open, starts, ends


def _comments(text: str):
    start = text.find("<!--")
    while start >= 0 and (end := text.find("-->", start + 4)) >= 0:
        yield start, end + 3, text[start + 4 : end]
        start = text.find("<!--", end + 3)


def concealed_in(text: str) -> list[tuple[int, str, int, int, str]]:
    """(place in the catalogue, kind, start, end, what is hidden) of all spans, by pattern."""
    elements, spans = _COMPILED
    low = text.lower()
    found = [(0, "comment", *span) for span in _comments(text)]
    names: dict[str, tuple] = {}
    for place, (kind, pattern, word, nests) in enumerate(elements, 1):
        upto = 0
        for m in pattern.finditer(text) if word in low else ():
            tag = m["tag"].lower()
            if m.start() < upto or nests and m["alone"]:
                continue
            if tag not in names:
                names[tag] = closings(text, tag)
            by_open, starts, ends = names[tag]
            at = bisect_left(starts, m.end())
            end = by_open.get(m.start()) if nests else ends[at] if at < len(ends) else None
            if end:
                found.append((place, kind, m.start(), end, text[m.start() : end]))
                upto = end
    for place, (kind, pattern, word) in enumerate(spans, len(elements) + 1):
        for m in pattern.finditer(text) if word in low else ():
            found.append((place, kind, m.start(), m.end(), m.groupdict().get("hidden", m[0])))
    return found


def _rows(batches):
    """Arrow batches (row, id, text) to located spans, and instructions as spans of kind `visible`."""
    for batch in pieces(batches):
        for row, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            out, line = [], {}
            spans = concealed_in(text or "")
            visible = [(99, "visible", m.start(), m.end(), m[0]) for m in _DIRECTIVE.finditer(text or "")]
            at, lines = 0, 1
            for start in sorted({s[2] for s in spans + visible}):
                lines += text.count("\n", at, start)
                at, line[start] = start, lines
            for place, kind, start, end, body in spans + visible:
                words = len(body.split())
                prose = kind in PROSE_KINDS and words >= LEAST_WORDS and not _MARKER.match(body.strip())
                out.append((place, kind, start, end, line[start], words, bool(_DIRECTIVE.search(html.unescape(body))), prose))
            columns = list(zip(*out)) or [[]] * len(_ROW)
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(out), pa.int64()), pa.array([key] * len(out), pa.string()), *(pa.array(c, t) for c, (_, t) in zip(columns, _ROW))], ["row", "id", *(n for n, _ in _ROW)])


def located(docs: DataFrame, key: str, text: str) -> DataFrame:
    """row, id, place, kind, start, end, line, words, directive, unexplained for every concealed span and instruction."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_rows, _SCHEMA)


def concealed_spans(docs: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    """All concealed spans: key, kind, start, end, line, words, directive, unexplained, and whether another span holds theirs."""
    spans = contained(located(docs, key, text).where("kind <> 'visible'"), ["row"], "nested", ["place"])
    return spans.select(F.col("id").cast(docs.schema[key].dataType).alias(key), "kind", "start", "end", "line", "words", "directive", "unexplained", "nested")


def injection_findings(docs: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    """Findings (key, id, priority, kind, start, end, line): hidden instructions, hidden prose, hidden messages and open instructions.

    A finding's span claims all that lies within, so a title in a reported comment is not counted again, nor is an instruction in a
    reported span counted as an open one. Hidden messages (see `hidden`) have no place.
    """
    spans = located(docs, key, text)
    claimed = outermost(spans.where("kind <> 'visible' and (directive or unexplained)"), ["row"], ["place"])
    open_ = covered(spans.where("kind = 'visible'"), claimed.select("row", "start", "end"), ["row"]).where(~F.col("covered"))
    name = F.when(F.col("directive"), "injection-hidden-directive").otherwise("injection-hidden-text")
    columns = ["id", "finding", "kind", "start", "end", "line"]
    found = claimed.withColumn("finding", name).select(*columns).unionByName(open_.withColumn("finding", F.lit("injection-visible-directive")).select(*columns))
    messages = hidden_messages(docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text")))
    nowhere = [F.lit(None).cast("long").alias(c) for c in ("start", "end", "line")]
    found = found.unionByName(messages.select(F.col("doc_id").alias("id"), F.lit("injection-tag-smuggling").alias("finding"), "kind", *nowhere))
    priority = F.when(F.col("finding").isin("injection-hidden-directive", "injection-tag-smuggling"), "P0").when(F.col("finding") == "injection-hidden-text", "P1").otherwise("P2")
    return found.select(F.col("id").cast(docs.schema[key].dataType).alias(key), F.col("finding").alias("id"), priority.alias("priority"), "kind", "start", "end", "line")


# A folding block, its summary line, and what stands for a block without one.
_DETAILS, _SUMMARY, UNNAMED = re.compile(r"(?i)<(/)?details(?(1)|\b[^>]*)>"), re.compile(r"(?i)<summary\b[^>]*>.*?</summary>"), "\n<details>\n"


def folded(text: str) -> str:
    """The text with every closed details block as its summary line, inner blocks first; one pass at any depth.

    What stands for a block without a summary opens a block again, as it does for a reader of the result.
    """
    stack, at = [[]], 0  # the parts of each open block, its opening tag first
    for m in _DETAILS.finditer(text):
        stack[-1].append(text[at : m.start()])
        at = m.end()
        if not m[1]:
            stack.append([m[0]])
        elif len(stack) == 1:
            stack[-1].append(m[0])
        else:
            body = "".join(stack.pop()[1:])
            if s := _SUMMARY.search(body):
                stack[-1].append(s[0])
            else:
                stack[-1].append("\n")
                stack.append(["<details>", "\n"])
    stack[-1].append(text[at:])
    return "".join(p for parts in stack for p in parts)


def fold_details(docs: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    """key and the folded text of every row; null stays null."""

    def run(batches):
        for batch in pieces(batches):
            texts = [None if t is None else folded(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "folded"])

    rows = docs.select(key, F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, folded string")
