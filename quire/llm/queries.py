"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The url rules (verdict, host, path).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_templates import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"), URL_RULES)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents"))


def op5_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_lm import perplexities

    return perplexities(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import remove_repeated_lines

    return remove_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), removed="n_removed")


def op8_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunk_store import store_and_sums

    return store_and_sums(_table(spark, sf_dir, "documents"))


def op9_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_crf import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(_table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_templates, op2_near_duplicates, op3_pack, op4_secret_scan, op5_quality_lm,
        op6_license_scan, op7_line_dedup, op8_chunk_store, op9_line_field, op10_decontaminate,
        op11_spelling_variants, op12_suffix_dedup, op13_ranked_search,
    )
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("text")}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id WHERE r.root < e.y),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""


def _license_sql() -> str:
    from .licenses import PERCENT, PHRASES, TEMPLATES, WIDTH

    split = "regexp_split_to_array(" + _LOWER.format("{0}") + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    words = "list_filter(" + split + ", lambda x: x <> '')"
    templates = ", ".join(f"({i}, '{label}', {sorted(set(text.split()))!r})" for i, (label, text) in enumerate(TEMPLATES))
    places = []
    for phrase, label in PHRASES.items():
        test = " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(phrase.split(), 1))
        places.append(f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(len(w)), lambda i: {test})) AS place FROM d")
    return f"""
WITH d AS (SELECT doc_id, text, {words.format("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT doc_id, pos, {words.format("line")} AS w FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
g AS (SELECT doc_id, pos, len(w) AS n, sum(len(w)) OVER o AS upto, sum((len(w) = 0)::INT) OVER o AS part FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
b AS (SELECT a.doc_id, list_slice(d.w, a.upto - a.n + 1, z.upto) AS w FROM g a JOIN g z ON a.doc_id = z.doc_id AND a.part = z.part AND z.pos >= a.pos AND (z.pos = a.pos OR z.upto - a.upto + a.n <= {WIDTH})
  JOIN d ON d.doc_id = a.doc_id WHERE a.n > 0 AND z.n > 0),
t(t, label, tokens) AS (VALUES {templates}),
hits AS (SELECT doc_id, label, len(list_intersect(list_distinct(w), tokens)) / len(tokens)::DOUBLE AS share FROM b, t WHERE list_has_any(w, tokens) AND 100 * len(list_intersect(list_distinct(w), tokens)) >= {PERCENT} * len(tokens)),
p AS ({" UNION ALL ".join(places)}),
base AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share FROM (SELECT doc_id, label, share FROM hits UNION ALL SELECT doc_id, label, 1.0 FROM p) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.lo::BIGINT AS first_word, base.hi::BIGINT AS last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, coalesce(every.share, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN every ON every.doc_id = d.doc_id"""


_OP7 = r"""
WITH raw AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
words AS (SELECT doc_id, i, regexp_replace(line, '^[ \t\r\x0B\f]+|[ \t\r\x0B\f]+$', '', 'g') AS line, len(list_filter(regexp_split_to_array(line, '[ \t\r\x0B\f]+'), lambda x: x <> '')) AS n FROM raw),
l AS (SELECT *, row_number() OVER w - 1 AS at_, sum(n) OVER w AS upto FROM words WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (
  SELECT a.doc_id, a.at_ AS s, min(b.at_) AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.at_ >= a.at_ AND b.upto >= a.upto - a.n + 50 GROUP BY ALL
  UNION SELECT b.doc_id, max(a.at_) AS s, b.at_ AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.at_ >= a.at_ AND b.upto >= a.upto - a.n + 50 GROUP BY b.doc_id, b.at_),
keyed AS (SELECT r.doc_id, r.s, r.e, string_agg(l.line, chr(10) ORDER BY l.at_) AS k FROM runs r JOIN l ON l.doc_id = r.doc_id AND l.at_ BETWEEN r.s AND r.e GROUP BY ALL),
firsts AS (SELECT k, min({'d': doc_id, 's': s}) AS f FROM keyed GROUP BY k HAVING count(*) > 1),
later AS (SELECT doc_id, CASE WHEN doc_id = f.d THEN greatest(s, f.s + e - s + 1) ELSE s END AS s, e FROM keyed JOIN firsts USING (k) WHERE NOT (doc_id = f.d AND s = f.s)),
cut AS (SELECT DISTINCT l.doc_id, l.i FROM later JOIN l ON l.doc_id = later.doc_id AND l.at_ BETWEEN later.s AND later.e),
left_ AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c IS NULL), '') AS text, count(c) AS n_removed FROM (SELECT raw.*, cut.i AS c FROM raw LEFT JOIN cut USING (doc_id, i)) GROUP BY doc_id)
SELECT doc_id, CASE WHEN n_removed > 0 THEN left_.text ELSE documents.text END AS text, n_removed::INT AS n_removed FROM documents JOIN left_ USING (doc_id)"""


# Whole numbers: a CRC by its table, byte by byte; letters beyond ASCII are two bytes.
_OP11 = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS t),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
low AS (SELECT d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT d, r, n, flatten(list_transform(string_split(d || ':' || r, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + ord(c) // 64, 128 + ord(c) % 64] END)) AS b FROM low),
marked AS (SELECT r, n, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x::BIGINT) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM bytes, crc),
made AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2) ELSE r END AS word, n FROM marked),
w AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r FROM places),
near AS (SELECT a.word, b.word AS near, b.n FROM holes a JOIN holes b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN w ON w.word = h.l || h.r
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN w ON w.word = h.l || h.r),
best AS (SELECT word, count(*) AS n_near, min({'less': -n, 'near': near}) AS b FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 5 * w.n THEN b.near END AS form, CASE WHEN -b.less >= 5 * w.n THEN -b.less END AS form_n FROM w LEFT JOIN best USING (word)),
chain(word, at_) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at_ WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at_ AS root FROM chain c JOIN forms f ON f.word = c.at_ WHERE f.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms JOIN ends USING (word)"""


def _search_sql() -> str:
    terms = "regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {terms} AS t FROM documents),
s AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
p AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(t) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, floor(1000 * ln((2.0 * (SELECT n FROM s) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p GROUP BY t),
m AS (SELECT k, doc_id, 100 - 75 + (75 * len(t) * n) // l AS m FROM d, s WHERE len(t) > 0),
i AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({terms}) AS t FROM benchmark) GROUP BY ALL),
x AS (SELECT item_id, k, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN df USING (t) JOIN p USING (t) JOIN m USING (k) GROUP BY item_id, k),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM x JOIN m USING (k) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10"""


#: The other operators hold learned or iterative steps, or token ids, that SQL has no form for.
SQL: dict[str, str] = {"op2_near_duplicates": _OP2, "op6_license_scan": _license_sql(), "op7_line_dedup": _OP7, "op11_spelling_variants": _OP11, "op13_ranked_search": _search_sql()}
