"""What a rewrite has kept: spans and facts of a text before and after, as multisets, and the verdict on each pair.

Code, tables, block quotes, paths, image sources, front matter and links are compared as written (links without an assistant's parameters), headings by level and
lower-cased title, numbers, dates and quotations by their canonical form in prose that nothing else covers. Dashes and marks of generated prose may not
grow in number. Everything is lost or added by count. A pair is one row: what both texts begin with is left out as far as nothing can be lost in it, the
items of the rests are made in one pass each, and the kinds whose items differ are compared.

Pairs (id, original, rewritten) need unique ids that are not null. A null text is an empty one. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import markdown as M
from quire.functions.text import bound, without_parameters

from . import facts
from .joins import runs

# A path with an extension, tags and images of HTML, dashes that join clauses, and marks of generated prose.
# Letters of a word (WORD_LETTERS) by what they are not, one by one: Java looks such a class up in a table and goes through ranges.
_NO_W = "".join(f"\\x{i:02x}" for i in range(128) if not (chr(i).isalnum() or chr(i) == "_"))
_NO_STEP = _NO_W.replace(r"\x2d", "").replace(r"\x2e", "")
PATH = rf"(?<![^{_NO_W.replace(r'\x2f', '')}])(?:\.{{0,2}}/)?(?:[^{_NO_STEP}]++/)+[^{_NO_STEP}]+\.[^{_NO_W}]{{1,6}}(?![^{_NO_W}])"
TAG, IMAGE_TAG = r"</?[a-zA-Z][^>]*>", r"(?i)<img[^>]+src\s*=\s*[\"']([^\"']+)[\"']"
IMAGE_SOURCE, IMAGE_ALT = r"!\[[^\]]*\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)", r"(?<=!\[)[^\]]+(?=\]\([^)\s]+(?:\s+\"[^\"]*\")?\))"
HEADING = r"(?dm:^)(#{1,6}\s+[^\n]*?)\s*(?dm:$)"
_EN = "(?:–|&(?:ndash|#8211|#[xX]2013);)"
DASH = f"(?=[—–&])(?:—|&(?:mdash|#8212|#[xX]2014);|{_EN}(?![0-9])|(?<![0-9]){_EN})"
TELLS = [
    r"(?=[dtnsmrcpugvbe])\b(?:delve|tapestry|nestled|showcasing|testament to|meticulous|seamless|robust|cutting-edge|pivotal|underscores|game-changer|vibrant|bustling|ever-evolving)\b",
    r"(?=[igltes][ renthx])(?:i hope this helps|great question|let's dive in|in conclusion|the future looks bright|it's worth noting|experts believe|studies show)",
    r"(?:it'?s not (?:just )?[^.;!?\n]{2,50}[,;] it'?s)",
]

#: Kinds that a flag makes a change instead of a violation.
STRUCTURE, FACTS, DASHES = ["heading", "heading count"], ["number", "date", "quotation"], ["dashes"]


#: What opens a span that may run on over lines and sentences.
_OPENING = "\"\u201c<\\[`~"
#: A beginning without any, up to the last plain word and period before a letter (h might begin a URL, which is masked), in a line that begins with a letter
#: and is no row or quote.
CLOSED = rf"\A([^{_OPENING}]*(?dm:^)[A-Za-z][^\n|>{_OPENING}]* [a-z]{{2,}}\.[ \n])[A-Za-gi-z]"
#: A mark of a heading whose title is looked for on the lines after it.
BARE_MARK = r"#\s*\n"


_TOLD = "array<struct<kind: string, item: string, lost: bigint, added: bigint>>"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})" if group == 0 else pattern), F.lit(max(group, 1)))


def _parted(a: Column, b: Column) -> Column:
    """{head, a, b}: a beginning that both texts have and nothing reaches out of, and what follows it in each.

    What is kept, counted or masked in a text is then that of its head and that of its rest. A head ends where no pattern of this module goes on: each
    needs an opening mark for that, white space after a digit, a month or a heading's mark, or the first characters of a line or of the text.
    """

    def common(x: Column) -> Column:
        longer = lambda k, step: (k + step <= x["n"]) & (F.substring(x["a"], k + 1, step) == F.substring(x["b"], k + 1, step))
        return F.aggregate(F.array(*(F.lit(1 << i) for i in range(30, -1, -1))), F.lit(0), lambda k, step: F.when(longer(k, step), k + step).otherwise(k))

    def parted(x: Column, head: Column) -> Column:
        front = lambda c: F.regexp_extract(x[c], M.FRONTMATTER, 0)
        closed = (head != "") & ~head.rlike(BARE_MARK) & (front("a") == front("b")) & (F.length(front("a")) <= F.length(head))
        rest = lambda c, n: F.substring(x[c], n + 1, F.length(x[c]))
        return bound(F.when(closed, head).otherwise(""), lambda h: F.struct(h.alias("head"), rest("a", F.length(h)).alias("a"), rest("b", F.length(h)).alias("b")))

    pair = F.struct(a.alias("a"), b.alias("b"), F.least(F.length(a), F.length(b)).alias("n"))
    return bound(pair, lambda x: bound(F.regexp_extract(F.substring(x["a"], F.lit(1), common(x)), CLOSED, 1), lambda head: parted(x, head)))


def _items(raw: Column, prose: Column) -> Column:
    """{kind, items} of all that a rewrite must keep."""

    def of(plain: Column, told: Column) -> list[tuple[str, Column]]:
        sources = F.filter(F.concat(_all(prose, IMAGE_SOURCE, 1), _all(prose, IMAGE_TAG, 1)), lambda s: ~s.rlike("^" + M.URL) & ~s.rlike(PATH))
        return [
            ("code block", _all(raw, M.FENCE)), ("inline code", _all(raw, M.INLINE_CODE)), ("table row", _all(prose, M.TABLE_ROW)), ("block quote", _all(prose, M.BLOCK_QUOTE)),
            ("path", _all(plain, PATH)), ("image source", sources), ("front matter", F.filter(F.array(F.regexp_extract(raw, M.FRONTMATTER, 0)), lambda x: x != "")),
            ("link", F.transform(_all(raw, M.URL), lambda u: without_parameters(u))),
            ("heading", F.transform(_all(prose, HEADING, 1), lambda h: F.lower(F.regexp_replace(h, r"^(#+)\s+", "$1 ")))),
            ("number", facts.numbers(told)), ("date", facts.dates(told)), ("quotation", facts.quotes(told)),
        ]

    # Each copy of the text is made once.
    named = lambda plain, told: F.array(*(F.struct(F.lit(kind).alias("kind"), items.alias("items")) for kind, items in of(plain, told)))
    from_plain = lambda plain: bound(M.blank_all(plain, TAG, M.ENTITY), lambda told: named(plain, told))
    return bound(M.blank_all(prose, IMAGE_ALT, M.URL, M.INLINE_CODE, M.TABLE_ROW, M.BLOCK_QUOTE), from_plain)


def _counts(prose: Column) -> Column:
    """{kind, n}: how many dashes and marks of generated prose the judged part of a text holds, and how many headings."""

    def of(judged: Column) -> Column:
        tells = sum((F.regexp_count(judged, F.lit("(?i)" + pattern)) for pattern in TELLS[1:]), F.regexp_count(judged, F.lit("(?i)" + TELLS[0])))
        kinds = {"dashes": F.regexp_count(judged, F.lit(DASH)), "tells": tells, "heading count": F.size(_all(prose, HEADING, 1))}
        return F.array(*(F.struct(F.lit(k).alias("kind"), n.alias("n")) for k, n in kinds.items()))

    return bound(M.blank_all(prose, *M.UNJUDGED), of)


def _with_prose(raw: Column, f) -> Column:
    return bound(M.blank_all(raw, M.FRONTMATTER, M.FENCE), f)


def _more(a: Column, b: Column) -> Column:
    """{item, n} of what array a holds more often than b."""
    # The k-th copy of an item is the item, a mark and k, as arrays of strings are compared by hashes.
    numbered = lambda items: bound(F.sort_array(items), lambda s: F.flatten(F.transform(runs(s, lambda x: x, lambda i, x: i), lambda r: F.transform(F.sequence(F.lit(1).cast("bigint"), r["n"]), lambda k: F.concat(r["item"], F.lit("\u0000"), k.cast("string"))))))
    number = lambda x: F.substring_index(x, "\u0000", -1)
    return bound(F.array_except(numbered(a), numbered(b)), lambda left: runs(left, lambda x: F.substring(x, F.lit(1), F.length(x) - F.length(number(x)) - 1), lambda i, x: number(x).cast("bigint")))


def _changed(head: Column, a: Column, b: Column) -> Column:
    """Array of {kind, item, lost, added} of two texts with their items and counts, after a head."""
    told = lambda kind, item, lost, added: F.struct(kind.alias("kind"), item.alias("item"), lost.cast("bigint").alias("lost"), added.cast("bigint").alias("added"))

    def moved(x: Column, y: Column) -> Column:
        lost = F.transform(_more(x["items"], y["items"]), lambda r: told(x["kind"], r["item"], r["n"], F.lit(0)))
        return F.concat(lost, F.transform(_more(y["items"], x["items"]), lambda r: told(x["kind"], r["item"], F.lit(0), r["n"])))

    def said(kinds: Column, before: Column) -> Column:
        of = lambda x: F.get(F.filter(before, lambda h: h["kind"] == x["kind"]), F.lit(0))["n"]
        return F.transform(kinds, lambda x: bound(of(x), lambda n: told(x["kind"], F.concat((n + x["a"]).cast("string"), F.lit(" -> "), (n + x["b"]).cast("string")), F.lit(1), F.lit(0))))

    differ = F.filter(F.zip_with(a["items"], b["items"], lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"]["items"] != p["y"]["items"])
    kinds = F.zip_with(a["counts"], b["counts"], lambda x, y: F.struct(x["kind"].alias("kind"), x["n"].alias("a"), y["n"].alias("b")))
    grown = F.filter(kinds, lambda x: (x["b"] > x["a"]) | (x["kind"] == "heading count") & (x["b"] != x["a"]))
    # What the head holds is counted only where it must be told.
    counted = bound(grown, lambda g: F.when(F.size(g) > 0, bound(_with_prose(head, _counts), lambda before: said(g, before))).otherwise(F.array().cast(_TOLD)))
    return F.concat(F.flatten(F.transform(differ, lambda p: moved(p["x"], p["y"]))), counted)


def _compared(pairs: DataFrame) -> DataFrame:
    """id and the array of changes of each pair: each is one row, without a shuffle."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    both = lambda raw: _with_prose(raw, lambda prose: F.struct(_items(raw, prose).alias("items"), _counts(prose).alias("counts")))
    # In steps, as the analyzer resolves only so many lambdas within each other.
    p = pairs.select("id", _parted(text("original"), text("rewritten")).alias("t"))
    p = p.select("id", F.col("t.head").alias("head"), both(F.col("t.a")).alias("a"), both(F.col("t.b")).alias("b"))
    return p.select("id", _changed(F.col("head"), F.col("a"), F.col("b")).alias("changes"))


def changes(pairs: DataFrame) -> DataFrame:
    """id, kind, item, lost, added: every kept thing whose number differs between the texts of a pair; counts that grew as items `before -> after`."""
    # Inline without outer would compute the changes again, to filter by their number.
    return _compared(pairs).select("id", F.inline_outer("changes")).where("kind is not null")


def _free(structure: bool = False, fact: bool = False, dashes: bool = False) -> list[str]:
    return STRUCTURE * structure + FACTS * fact + DASHES * dashes


def violations(pairs: DataFrame, structure: bool = False, fact: bool = False, dashes: bool = False) -> DataFrame:
    """id, kind, item, n, allowed of what a rewrite has lost; a flag allows the kinds of STRUCTURE, FACTS or DASHES."""
    free = _free(structure, fact, dashes)
    return changes(pairs).where("lost > 0").select("id", "kind", "item", F.col("lost").alias("n"), F.col("kind").isin(free).alias("allowed"))


def verdicts(pairs: DataFrame, **flags: bool) -> DataFrame:
    """id, ok, hard, soft of every pair: whether nothing is lost that must be kept, and how many violations and allowed changes there are."""
    free = _free(**flags)
    sums = lambda c: F.struct(*(F.size(F.filter(c, lambda x: (x["lost"] > 0) & (x["kind"].isin(free) == allowed))).cast("bigint").alias(k) for k, allowed in (("hard", False), ("soft", True))))
    found = _compared(pairs).select("id", bound(F.col("changes"), sums).alias("n")).select("id", "n.hard", "n.soft")
    return found.select("id", (F.col("hard") == 0).alias("ok"), "hard", "soft")
