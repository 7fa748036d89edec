"""Column functions over markdown: masks that keep offsets, prose alone, bare URLs, sections.

All are built-in expressions. A null text gives null, an empty one an empty text or array. Lines end with \\n.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

# The shapes of markdown. A fence or code span closes with the marks that opened it.
FRONTMATTER = r"\A---\n(?s:.*?)\n---\n"
FENCE = r"(?dm:^)[ \t]*(?<fence>`{3,}|~{3,})(?s:.*?)(?:(?dm:^)[ \t]*\k<fence>[`~]*|\z)"
INLINE_CODE = r"(?=`)(?<!`)(?<tick>`+)(?!`)(?:(?!\k<tick>)[^\n])+?\k<tick>(?!`)"
TABLE_ROW = r"(?dm:^)\s*\|[^\n]*\|\s*(?dm:$)"
BLOCK_QUOTE = r"(?dm:^)\s*>[^\n]*"
QUOTED = r"\"(?:[^\"\n]|\n[ \t]*[^ \t\n\"]){0,400}(?:\n[ \t]*)?\"|“(?:[^”\n]|\n[ \t]*[^ \t\n”]){0,400}(?:\n[ \t]*)?”"
HEADING_LINE = r"(?dm:^)#{1,6}\s+[^\n]*"
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
IMAGE = r"!\[[^\]]*\]\([^)\s]+(?:\s+\"[^\"]*\")?\)"
LINK = r"(?<!!)\[[^\]]*\]\([^)\s]+(?:\s+\"[^\"]*\")?\)"
ATTRIBUTE_URL = r"(?i:src|href)\s*=\s*[\"'][^\"']*[\"']"
AUTOLINK = r"<https?://[^>]+>"
DEFINITION = r"(?dm:^)\s*\[[^\]]+\]:\s*\S+"
URL, WHOLE_URL = r"https?://[^\s)>\]\"']+", r"https?://\S+"


def blank(text: Column, pattern: str) -> Column:
    """Every match becomes white space of its length, line breaks and tabs kept: offsets stay valid.

    The text is computed once, so that masks in a row cost as many passes as there are masks.
    """

    def masked(t: Column, hits: Column) -> Column:
        spaces = F.transform(hits, lambda m: F.regexp_replace(m, r"\S", " "))
        return F.array_join(F.zip_with(F.split(t, pattern, -1), spaces, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")

    hits = lambda t: F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))
    return bound(text, lambda t: bound(hits(t), lambda h: F.when(F.size(h) > 0, masked(t, h)).otherwise(t)))


def blank_all(text: Column, *patterns: str) -> Column:
    return reduce(blank, patterns, text)


def without(text: Column, *patterns: str) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), patterns, text)


#: What no rule may judge, beyond front matter and code blocks.
UNJUDGED = (INLINE_CODE, TABLE_ROW, BLOCK_QUOTE, QUOTED)


def scored(text: Column) -> Column:
    """The text with all spans masked that no rule may judge: front matter, code, tables, quotations."""
    return blank_all(text, FRONTMATTER, FENCE, *UNJUDGED)


def prose_copy(text: Column) -> Column:
    """The text with code masked."""
    return blank_all(text, FENCE, INLINE_CODE)


def prose(text: Column) -> Column:
    """The text without markup, for measures: front matter, code, tables, URLs, headings, block quotes and emphasis go; list items stay."""
    return without(text, FRONTMATTER, FENCE, INLINE_CODE, TABLE_ROW, WHOLE_URL, HEADING_LINE, BLOCK_QUOTE, "[*_`]")


def without_code_blocks(text: Column) -> Column:
    return without(text, FENCE)


def bare_urls(text: Column) -> Column:
    """URLs that stand in no link, image, attribute, definition or code."""
    return F.regexp_extract_all(blank_all(text, IMAGE, LINK, ATTRIBUTE_URL, AUTOLINK, DEFINITION, INLINE_CODE), F.lit(f"({URL})"), F.lit(1))


def sections(text: Column) -> Column:
    """Sections (line, level, title, upto) by the headings outside code; lines count from 1, a section ends before the next heading."""
    lines = F.split(blank_all(text, FRONTMATTER, FENCE), "\n", -1)
    levels = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), F.regexp_extract(x, r"^(#{1,6})[ \t]+", 1).alias("mark"), F.regexp_extract(x, r"^#{1,6}[ \t]+(.*?)\s*$", 1).alias("title")))
    both = F.struct(F.size(lines).alias("size"), F.filter(levels, lambda x: x["mark"] != "").alias("found"))
    end = lambda b, i: F.coalesce(F.get(b["found"], i + 1)["line"] - 1, b["size"])
    named = lambda b: F.transform(b["found"], lambda x, i: F.struct(x["line"].alias("line"), F.length(x["mark"]).alias("level"), x["title"].alias("title"), end(b, i).alias("upto")))
    return F.when(text.isNotNull(), F.get(F.transform(F.array(both), named), F.lit(0)))
