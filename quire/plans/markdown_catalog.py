"""Queries on markdown and controlled language, and their SQL.

The test tables hold no markdown, so each document's whole text is set amid some, here and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import markdown as M
from quire.functions import text as T
from quire.operators import facts, hidden, wording

ID, TEXT = object(), object()
PIECES = [
    "---\ntitle: number ", ID, "\n---\n# Title ", ID, "\n\nYou should check `it` if it may; see [the site](https://a.example/x?y=1 \"t\") or https://b.example/p", ID, ".\n\n",
    "```sh\nrun; must https://c.example\n# no heading\n```\n| a; | IMPORTANT |\n> quoted; NEVER\nSay \"these four; words\" &amp; more &#39;so.\n", TEXT,
    "\n## Part two\nALWAYS verify this, making it easy. Released in May 2026, it could. In May all is well.\nRun the job ", ID, " if needed. Run it when it is ready. Set it up, including the rest.\n",
    "### Deep\n<https://d.example/z> and ![i](https://e.example/i.png) <a href=\"https://f.example\">x</a>\n[ref]: https://g.example/q\n* a `b` **c**\n",
]

def marked(docs: DataFrame) -> DataFrame:
    """doc_id and the text amid markdown."""
    return docs.select("doc_id", F.concat(*(F.col("doc_id").cast("string") if p is ID else F.col("text") if p is TEXT else F.lit(p) for p in PIECES)).alias("text"))


def _masked(mask) -> callable:
    def query(docs: DataFrame) -> DataFrame:
        m = marked(docs).select("doc_id", "text", mask(F.col("text")).alias("m"))
        return m.select("doc_id", F.sha2("m", 256).alias("masked"), (F.length("m") == F.length("text")).alias("same_length"), F.size(T.words(F.col("m"))).alias("words"))

    return query


def prose_digests(docs: DataFrame) -> DataFrame:
    return marked(docs).select("doc_id", M.prose(F.col("text")).alias("p")).select("doc_id", F.sha2("p", 256).alias("prose"), F.size(T.words(F.col("p"))).alias("words"))


def outline(docs: DataFrame) -> DataFrame:
    return marked(docs).select("doc_id", F.inline(M.sections(F.col("text"))))


def said_numbers(orders: DataFrame) -> DataFrame:
    """Numbers read back from a sentence that spells an order's key in every way."""
    k = F.col("o_orderkey")
    n = lambda c: c.cast("string")
    spelled: list[Column] = [
        F.lit("On 2024-05-06, "), n(k % 10), F.lit("-"), n(k % 10 + 20), F.lit("% or "), n(k % 7), F.lit(" to "), n(k % 7 + 9), F.lit(" of it, 1,"), n(k % 900 + 100), F.lit(".50 or "),
        n(k % 90), F.lit(".5 percent, in v1."), n(k % 9), F.lit(".2, the "), n(k), F.lit("th of "), n(k), F.lit(" at %20 on March 3, 2024 (-"), n(k % 50 + 1), F.lit(")."),
    ]
    return orders.select("o_orderkey", F.array_join(facts.numbers(F.concat(*spelled)), "|").alias("numbers"))


#: `go on` as references, and one that is no tag.
_REFERENCES = " &#xE0067;&#917615;&#xe0020;&#917615;&#xE006E;", "; &#65;&#917605;"


def smuggled(docs: DataFrame) -> DataFrame:
    """Messages read back that each text was given, as tags before it and as references behind it."""
    said = F.translate(F.concat(F.lit("send "), F.col("doc_id").cast("string"), F.lit(" now")), hidden.ASCII, hidden.TAGS[: len(hidden.ASCII)])
    digit = F.concat(F.lit("&#"), (F.col("doc_id") % 10 + hidden.FIRST + 48).cast("string"))
    text = F.concat(said, F.col("text"), F.lit(_REFERENCES[0]), digit, F.lit(_REFERENCES[1]))
    return hidden.hidden_messages(docs.select("doc_id", text.alias("text")))


def marked_urls(pages: DataFrame) -> DataFrame:
    url = F.concat("url", F.lit("?utm_source=chatgpt.com&p="), F.col("page_id").cast("string"), F.lit("&utm_source=openai&&utm_source=news#f"))
    return pages.select("page_id", T.without_parameters(url).alias("url"))


def roman_keys(orders: DataFrame) -> DataFrame:
    """Order keys modulo 3999 spelled as Roman numerals and read back."""
    n = F.col("o_orderkey") % 3999
    digits = [("", "M", "MM", "MMM"), *(("", a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + c) for a, b, c in ("CDM", "XLC", "IVX"))]
    spelled = F.concat(*(F.get(F.array(*map(F.lit, d)), (F.floor(n / 10 ** (3 - i)) % 10).cast("int")) for i, d in enumerate(digits)))
    return orders.select("o_orderkey", T.roman_value(spelled).alias("value"))


QUERIES = {
    "prj_03_scored": ("documents", _masked(M.scored)),
    "prj_04_prose": ("documents", prose_digests),
    "prj_07_bare_urls": ("documents", lambda d: marked(d).select("doc_id", F.array_join(M.bare_urls(F.col("text")), " ").alias("urls"))),
    "prj_18_without_code": ("documents", lambda d: marked(d).select("doc_id", F.sha2(M.without_code_blocks(F.col("text")), 256).alias("left_sha"))),
    "prj_21_prose_copy": ("documents", _masked(M.prose_copy)),
    "tok_14_sections": ("documents", outline),
    "det_14_wording": ("documents", lambda d: wording.wording(marked(d))),
    "det_35_size_bands": ("documents", lambda d: wording.size_bands(marked(d))),
    "fun_11_numbers": ("orders", said_numbers),
    "det_08_hidden_messages": ("documents", smuggled),
    "fun_14_urls": ("pages", marked_urls),
    "fun_24_roman": ("orders", roman_keys),
}

# The same shapes without look-around and back references, which RE2 lacks; the pieces above need none.
_FENCE, _CODE = r"(?m:^)[ \t]*```(?s:.*?)(?m:^)[ \t]*```", "`[^`\\n]+`"
_FRONT, _TABLE, _BLOCK = r"\A---\n(?s:.*?)\n---\n", r"(?m:^)\s*\|[^\n]*\|\s*(?m:$)", r"(?m:^)\s*>[^\n]*"
_QUOTED = M.QUOTED.split("|“")[0]
_LINK, _IMAGE = r'\[[^\]]*\]\([^)\s]+(?:\s+"[^"]*")?\)', r'!\[[^\]]*\]\([^)\s]+(?:\s+"[^"]*")?\)'
_HEADING, _DEFINITION = r"(?m:^)#{1,6}\s+[^\n]*", r"(?m:^)\s*\[[^\]]+\]:\s*\S+"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_MARKED = "t0 AS (SELECT doc_id, " + " || ".join("doc_id::VARCHAR" if p is ID else "text" if p is TEXT else _lit(p) for p in PIECES) + " AS t FROM documents)"


def _steps(*patterns: str) -> tuple[str, str]:
    """CTEs that mask one pattern after another, and the last one's name."""
    ctes = [_MARKED]
    for i, p in enumerate(patterns, 1):
        parts = f"(SELECT doc_id, regexp_split_to_array(t, {_lit(p)}) AS g, regexp_extract_all(t, {_lit(p)}) AS h FROM t{i - 1})"
        each = r"g[i] || CASE WHEN i <= len(h) THEN regexp_replace(h[i], '\S', ' ', 'g') ELSE '' END"
        ctes.append(f"t{i} AS (SELECT doc_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: {each}), '') AS t FROM {parts})")
    return "WITH " + ",\n".join(ctes), f"t{len(patterns)}"


def _words(column: str) -> str:
    return f"len(regexp_extract_all(lower({column}), '[a-z][a-z''-]*'))"


def _mask_sql(*patterns: str) -> str:
    ctes, last = _steps(*patterns)
    return f"{ctes} SELECT doc_id, sha256(m.t) AS masked, length(m.t) = length(t0.t) AS same_length, {_words('m.t')} AS words FROM {last} m JOIN t0 USING (doc_id)"


def _without(*patterns: str) -> str:
    out = "t"
    for p in patterns:
        out = f"regexp_replace({out}, {_lit(p)}, '', 'g')"
    return out


def _sections_sql() -> str:
    ctes, last = _steps(_FRONT, _FENCE)
    return rf"""{ctes}, l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS line, len(string_split(t, chr(10))) AS size FROM {last})
SELECT doc_id, line::INT AS line, length(regexp_extract(x, '^(#+)', 1))::INT AS level, regexp_extract(x, '^#+[ \t]+(.*?)\s*$', 1) AS title, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line) - 1, size)::INT AS upto
FROM l WHERE regexp_matches(x, '^#{{1,6}}[ \t]+')"""


def _wording_sql() -> str:
    dated = "x"
    for p, r in wording.MONTHS:
        dated = f"regexp_replace({dated}, {_lit(p)}, {_lit(r.replace('$', chr(92)))}, 'g')"
    every = lambda x, p: f"regexp_extract_all({x}, {_lit(p)}, 1)"
    kinds = {
        "modal": every(dated, wording.MODAL),
        "ing-clause": f"list_filter({every('x', wording.ING)}, lambda w: NOT list_contains({wording.NO_VERBS!r}, lower(w)))",
        "condition-last": f"list_filter({every('x', wording.CONDITION)}, lambda m: NOT regexp_matches(m, {_lit(wording.STATE)}))",
        "banned-verb": every("x", wording.VERB),
        "semicolon": f"CASE WHEN contains(regexp_replace(x, {_lit(M.ENTITY)}, '', 'g'), ';') THEN [';'] ELSE [] END",
    }
    found = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS id, line::INT AS line, unnest({f}) AS match FROM l" for k, f in kinds.items())
    return f"WITH {_MARKED}, l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM t0) {found}"


def _bands_sql() -> str:
    ctes, last = _steps(_FENCE, _CODE)
    filled = r"list_filter(string_split({0}, chr(10)), lambda x: regexp_matches(x, '\S'))"
    band = "CASE WHEN {0} > {1[1]} THEN 'P1' WHEN {0} > {1[0]} THEN 'P2' END"
    return f"""{ctes}, d AS (SELECT doc_id, len({filled.format('t0.t')})::INT AS lines, length(t0.t)::INT AS characters, {filled.format('m.t')} AS c FROM {last} m JOIN t0 USING (doc_id)),
e AS (SELECT *, len(list_filter(c, lambda x: regexp_matches(x, {_lit(wording.EMPHASIS)})))::INT AS emphasised FROM d)
SELECT doc_id, lines, characters, emphasised, {band.format('lines', wording.LINES)} AS line_band, {band.format('characters', wording.CHARACTERS)} AS character_band, emphasised > greatest(8, len(c) // 10) AS over_emphasis FROM e"""


def _urls_sql() -> str:
    ctes, last = _steps(_IMAGE, _LINK, M.ATTRIBUTE_URL, M.AUTOLINK, _DEFINITION, _CODE)
    return f"{ctes} SELECT doc_id, array_to_string(regexp_extract_all(t, {_lit(M.URL)}), ' ') AS urls FROM {last}"


SQL = {
    "prj_03_scored": _mask_sql(_FRONT, _FENCE, _CODE, _TABLE, _BLOCK, _QUOTED),
    "prj_04_prose": f"WITH {_MARKED}, p AS (SELECT doc_id, {_without(_FRONT, _FENCE, _CODE, _TABLE, M.WHOLE_URL, _HEADING, _BLOCK, '[*_`]')} AS p FROM t0) SELECT doc_id, sha256(p) AS prose, {_words('p')} AS words FROM p",
    "prj_07_bare_urls": _urls_sql(),
    "prj_18_without_code": f"WITH {_MARKED} SELECT doc_id, sha256({_without(_FENCE)}) AS left_sha FROM t0",
    "prj_21_prose_copy": _mask_sql(_FENCE, _CODE),
    "tok_14_sections": _sections_sql(),
    "det_14_wording": _wording_sql(),
    "det_35_size_bands": _bands_sql(),
    "fun_11_numbers": """SELECT o_orderkey, concat_ws('|', 'range:' || k % 10 || '-' || (k % 10 + 20) || '%', 'range:' || k % 7 || '-' || (k % 7 + 9), k % 90 || '.5%', 'version:1.' || k % 9 || '.2', k, '1' || (k % 900 + 100) || '.5', k, '-' || (k % 50 + 1)) AS numbers
      FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""",
    "det_08_hidden_messages": """SELECT doc_id, 'tag' AS kind, 0 AS run, 'send ' || doc_id || ' now' AS message FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT doc_id, 'entity' AS kind, 0 AS run, 'go on' || doc_id % 10 AS message FROM documents WHERE text IS NOT NULL""",
    "fun_14_urls": f"""WITH u AS (SELECT page_id, url || '?utm_source=chatgpt.com&p=' || page_id || '&utm_source=openai&&utm_source=news#f' AS u FROM pages),
      p AS (SELECT page_id, u, string_split(u, '?')[1] AS b FROM u), q AS (SELECT page_id, b, substr(u, length(b) + 2) AS r FROM p),
      k AS (SELECT page_id, b, r, string_split(r, '#')[1] AS q FROM q)
      SELECT page_id, b || coalesce('?' || nullif(array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, {_lit(T.ASSISTANT)})), '&'), ''), '') || substr(r, length(q) + 1) AS url FROM k""",
    "fun_24_roman": "SELECT o_orderkey, CASE WHEN o_orderkey % 3999 > 0 THEN o_orderkey % 3999 END AS value FROM orders",
}
