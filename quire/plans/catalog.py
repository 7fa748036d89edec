"""Registered queries over the test tables and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import ABBREVIATIONS, CLOSERS, MARKERS, WORD_LETTERS
from quire.operators import corpus, detectors, facts, gates, joins, lines, stats, stylometry
from quire.plans import markdown_catalog, span_catalog
from quire.streaming import scan


def _on(table: str, f: Callable[..., DataFrame], *more: str) -> Callable[[SparkSession, str], DataFrame]:
    """f over whole tables of a folder."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in (table, *more)))

    return query


#: Terms that the term counts look for.
TERMS = ["the", "of", "and", "with", "for", "that", "from", "what"]

# Stand-ins for hand-written allowances and registers, the same in SQL: every third document allows long
# sentences and every fourth long paragraphs; French texts skip long paragraphs.


def _allowances(docs: DataFrame) -> DataFrame:
    a = docs.where("doc_id % 3 = 0").select("doc_id", F.lit("long-sentence").alias("id"))
    return a.unionByName(docs.where("doc_id % 4 = 0").select("doc_id", F.lit("long-paragraph").alias("id")))


def _suppressed(docs: DataFrame) -> DataFrame:
    return gates.suppress(detectors.findings(docs), _allowances(docs)).groupBy("id", "suppressed").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def _tolerated(docs: DataFrame) -> DataFrame:
    skips = docs.sparkSession.createDataFrame([("fr", "long-paragraph")], "register string, id string")
    kept = gates.tolerated(detectors.findings(docs), docs.select("doc_id", F.col("lang").alias("register")), skips)
    return kept.groupBy("register", "id").agg(F.count("*").alias("n"))


def _manifest(docs: DataFrame) -> DataFrame:
    """A manifest in which every fifth digest is stale and every seventh text is gone."""
    stale = F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    return gates.manifest_check(docs.where("doc_id % 7 <> 0"), docs.select("doc_id", stale.alias("sha256")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "agg_01_doc_stats": _on("documents", stats.document_stats),
    "agg_01_trigram_repetition": _on("documents", stats.trigram_repetition),
    "fun_30_mattr": _on("documents", stats.moving_ttr),
    "tok_03_readability": _on("documents", stats.readability),
    "fun_22_ascii_share": _on("documents", stats.ascii_share),
    "agg_03_marker_rates": _on("documents", stylometry.marker_rates),
    "agg_04_marker_baseline": _on("documents", lambda d: stylometry.marker_baseline(d).select("source", "marker", "docs", *(F.round(c, 4).alias(c) for c in ("mean", "sd", "floored_sd")))),
    "agg_05_sentence_openers": _on("documents", stylometry.sentence_openers),
    "agg_06_measure_stats": _on("documents", stylometry.measure_stats),
    "agg_07_sentence_shape": _on("documents", stylometry.sentence_shape),
    "agg_08_self_distance": _on("documents", stylometry.self_distance),
    "agg_11_voice_distance": _on("documents", stylometry.voice_distance),
    "agg_13_measure_gaps": _on("documents", stylometry.measure_gaps),
    "agg_15_presence_rates": _on("documents", corpus.presence_rates),
    "agg_19_detector_score": _on("documents", lambda d, b: corpus.detector_score(d, b, F.col("text").rlike("[#*$%&|<>]")), "labels"),
    "agg_21_term_profile": _on("documents", stylometry.term_profile),
    "agg_23_ngram_mining": _on("conversations", corpus.ngram_mining),
    "agg_41_turn_removals": _on("conversations", joins.turn_removals),
    "join_02_fact_delta": _on("documents", joins.fact_delta),
    "join_07_repeated_lines": _on("documents", joins.repeated_lines),
    "join_09_overlap": _on("documents", joins.line_overlap),
    "join_09_links": _on("documents", joins.line_links),
    "join_11_verbatim": _on("documents", joins.verbatim, "benchmark"),
    "join_13_nearest": _on("embeddings", joins.nearest),
    "fun_19_digest_dedup": _on("documents", corpus.digest_dedup),
    "fun_10_dates": _on("orders", facts.order_dates),
    "fun_12_quotes": _on("documents", facts.quoted_texts),
    "fun_13_names": _on("documents", facts.fact_counts),
    "gat_01_turn_names": _on("conversations", facts.turn_facts),
    "cvio_trend_events": _on("events", corpus.trend),
    "det_13_long_paragraphs": _on("documents", detectors.long_paragraphs),
    "det_12_long_sentences": _on("documents", detectors.long_sentences),
    "det_06_concealed_spans": _on("pages", detectors.concealed_spans),
    "src_08_html_text": _on("pages", detectors.page_text),
    "agg_02_finding_rollup": _on("documents", detectors.finding_rollup),
    "prj_01_masked_numbers": _on("documents", lines.masked_numbers),
    "prj_10_first_number": _on("documents", lines.first_number),
    "prj_20_normal_digests": _on("documents", lines.normal_digests),
    "tok_09_paragraphs": _on("documents", lines.paragraphs),
    "agg_25_count_marks": _on("documents", lines.count_marks),
    "agg_22_count_terms": _on("documents", lambda d: lines.count_terms(d, TERMS)),
    "fun_31_reliability": _on("documents", lines.reliability),
    "fun_45_block_burstiness": _on("documents", lines.block_burstiness),
    "fun_01_inflections": _on("documents", lines.inflections),
    "det_52_ascii_problems": _on("documents", lines.ascii_problems),
    "det_19_passives": _on("documents", lines.passives),
    "det_65_picked": _on("documents", lines.picked),
    "agg_18_event_sequences": _on("events", lines.event_sequences),
    "ord_01_ranked": _on("documents", lambda d: gates.ranked(detectors.findings(d)).where("place <= 8").select("doc_id", "place", "id", "pos")),
    "join_03_suppressed": _on("documents", _suppressed),
    "join_04_audit": _on("documents", lambda d: gates.audit(detectors.findings(d), _allowances(d))),
    "join_05_tolerated": _on("documents", _tolerated),
    "join_29_manifest": _on("documents", _manifest),
    "det_01_past_allowance": _on("documents", lambda d: gates.past_allowance(detectors.findings(d), 3).select("doc_id", "id", "pos")),
    "agg_20_flagged": _on("documents", lambda d: gates.flagged(detectors.findings(d))),
    "agg_12_caricature": _on("documents", lambda d: gates.caricature(stylometry.long_measures(d))),
    "gat_01_turns": _on("conversations", gates.turn_gate),
    "str_02_scan": _on("documents", scan.scan),
    "str_event_windows": _on("events", scan.event_windows),
    **{name: _on(table, f) for name, (table, f) in markdown_catalog.QUERIES.items()},
    **{name: _on(tables[0], f, *tables[1:]) for name, (*tables, f) in span_catalog.QUERIES.items()},
}

# DuckDB forms of the text functions; {0} is the text.
_WORDS = "regexp_extract_all(lower({0}), '[a-z][a-z''-]*')"
_WS = r" \t\r\n\x0B\f"


def _sentences() -> str:
    """Sentences of {0}. What other engines say by looking behind is said by the character before, and twice, as matches may share it."""
    t = "translate({0}, chr(1) || chr(2), '')"
    letters = WORD_LETTERS.replace("{", "{{").replace("}", "}}")
    for _ in range(2):
        t = rf"regexp_replace({t}, '(^|[^{letters}])((?i:{'|'.join(ABBREVIATIONS)})|[A-Z])\.', '\1\2' || chr(1), 'g')"
    t = rf"regexp_replace({t}, '(?m)^[{_WS}]*([0-9]+)\.', '\1' || chr(1), 'g')"
    t = rf"regexp_replace({t}, '(?m)^([ \t\r\x0B\f]*)([-*+][{_WS}]|[0-9]+\)[{_WS}]|[0-9]+\x01)', chr(2) || '\1\2', 'g')"
    closers = CLOSERS.replace("'", "''")
    t = rf"regexp_replace({t}, '([.!?][{closers}]?)[{_WS}]+', '\1' || chr(2), 'g')"
    return rf"list_filter(list_transform(string_split({t}, chr(2)), lambda s: replace(regexp_replace(s, '^[{_WS}]+|[{_WS}]+$', '', 'g'), chr(1), '.')), lambda s: s <> '')"


_SENTENCES = _sentences()
_LENGTHS = "list_filter(list_transform(" + _SENTENCES + ", lambda s: len(" + _WORDS.format("s") + ")), lambda n: n > 0)"
_GRAMS = "list_transform(range(1, len({0}) - {1} + 2), lambda i: array_to_string(list_slice({0}, i, i + {1} - 1), ' '))"
_NORM = r"lower(regexp_replace(regexp_replace(regexp_replace({0}, '^[ \t]*([-*+]|[0-9]+[.)])[ \t]+', ''), '[ \t\r\n]+', ' ', 'g'), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'))"
_MARKERS = "(" + ", ".join("'" + m.replace("'", "''") + "'" for m in MARKERS) + ")"
_STATS = f"""
SELECT doc_id, source, len(w) AS word_count, len(n) AS sentence_count, len(list_distinct(w)) AS n_types,
  CASE WHEN len(w) > 0 THEN round(len(list_distinct(w)) / len(w)::DOUBLE, 6) END AS ttr,
  round(list_avg(n), 6) AS avg_sentence_words,
  round(CASE WHEN len(n) > 1 THEN list_stddev_samp(n) WHEN len(n) = 1 THEN 0.0 END, 6) AS sentence_sd,
  round(CASE WHEN len(n) > 1 THEN list_stddev_samp(n) WHEN len(n) = 1 THEN 0.0 END / nullif(list_avg(n), 0), 6) AS burstiness,
  list_max(n) AS longest_sentence, list_min(n) AS shortest_sentence
FROM (SELECT doc_id, source, {_WORDS.format("text")} AS w, {_LENGTHS.format("text")} AS n FROM documents)"""
_COUNTS = f"""
counts AS (SELECT source, doc_id, words, marker, count(*) AS n
  FROM (SELECT source, doc_id, len(w) AS words, unnest(w) AS marker FROM (SELECT source, doc_id, {_WORDS.format("text")} AS w FROM documents WHERE lang = 'en'))
  WHERE marker IN {_MARKERS} GROUP BY ALL)"""
_BASE = f"""{_COUNTS},
writers AS (SELECT source, count(*) AS docs FROM documents WHERE lang = 'en' AND len({_WORDS.format("text")}) > 0 GROUP BY source),
sums AS (SELECT source, marker, sum(1000.0 * n / words) AS s, sum((1000.0 * n / words) ** 2) AS q FROM counts GROUP BY ALL),
base0 AS (SELECT source, marker, docs, s / docs AS mean, CASE WHEN docs > 1 THEN sqrt(greatest((q - docs * (s / docs) * (s / docs)) / (docs - 1), 0.0)) ELSE 0.0 END AS sd FROM sums JOIN writers USING (source)),
base AS (SELECT *, greatest(sd, 0.25 * mean, 0.5) AS floored_sd FROM base0)"""
# Every document against every marker of its writer's baseline: the plain form of the Delta.
_DELTAS = f"""{_BASE},
full_rates AS (SELECT d.source, d.doc_id, b.marker, b.docs, b.mean, b.floored_sd, coalesce(1000.0 * c.n / c.words, 0.0) AS x
  FROM (SELECT source, doc_id FROM documents WHERE lang = 'en' AND len({_WORDS.format("text")}) > 0) d JOIN base b USING (source)
  LEFT JOIN counts c ON c.doc_id = d.doc_id AND c.marker = b.marker),
loo AS (SELECT source, doc_id, sum(least(abs(x - (mean * docs - x) / (docs - 1)) / floored_sd, 4.0)) / {len(MARKERS)} AS delta FROM full_rates WHERE docs > 1 GROUP BY ALL),
own AS (SELECT source, doc_id, sum(least(abs(x - mean) / floored_sd, 4.0)) / {len(MARKERS)} AS delta FROM full_rates GROUP BY ALL)"""
_LONG = f"""measures AS (SELECT source, doc_id, unnest(['word_count', 'avg_sentence_words', 'burstiness', 'ttr']) AS measure,
  unnest([word_count::DOUBLE, avg_sentence_words, burstiness, ttr]) AS value FROM ({_STATS})), m AS (SELECT * FROM measures WHERE value IS NOT NULL)"""
_LINES = f"keys AS (SELECT * FROM (SELECT doc_id, {_NORM.format('line')} AS norm FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE length(norm) >= 40)"
_FACTS = r"coalesce(list_transform(list_transform(regexp_extract_all(text, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: replace(x, ',', '')), lambda x: {0}), [])"


def _overlaps(classes: str) -> str:
    """SQL for pairs of the classes u (id, lines, ...) that share three tenths of the smaller set's lines."""
    return f"""{_LINES}, s AS (SELECT doc_id, list(DISTINCT norm ORDER BY norm) AS lines FROM keys GROUP BY doc_id), u AS ({classes}), v AS (SELECT id, len(lines) AS size, unnest(lines) AS norm FROM u),
      met AS (SELECT a.id AS first_id, b.id AS doc_id, count(*) AS common, least(any_value(a.size), any_value(b.size)) AS smaller FROM v a JOIN v b ON a.norm = b.norm AND a.id < b.id GROUP BY ALL),
      pairs AS (SELECT * FROM met WHERE 100 * common >= 30 * smaller)"""


_OVERLAPS = _overlaps("SELECT min(doc_id) AS id, lines FROM s GROUP BY lines")
# Where letters beyond ASCII stand as _, an ASCII word boundary is one for every letter.
_NAMES = facts.NAMES.replace(f"(?![{WORD_LETTERS}])", r"\b").replace(f"(?<![{WORD_LETTERS}])", r"\b")
_NUMBER = r"""CASE WHEN try_cast(x AS DOUBLE) = floor(try_cast(x AS DOUBLE)) AND abs(try_cast(x AS DOUBLE)) < 1e15 THEN try_cast(x AS DOUBLE)::BIGINT::VARCHAR ELSE regexp_replace(x, '0+$', '') END"""
_LONG_P = f"SELECT doc_id, pos - 1 AS pos, len({_SENTENCES.format('p')}) AS n FROM (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE len({_SENTENCES.format('p')}) > 6"
_LONG_S = f"""SELECT doc_id, pos, n, hit FROM (SELECT doc_id, pos, n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS hit FROM
  (SELECT doc_id, pos - 1 AS pos, len({_WORDS.format('s')}) AS n FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, {_SENTENCES.format('text')} AS l FROM documents))) WHERE n > 25) WHERE hit > 6"""
_HTML = "html"
for _rx, _to in (
    (r"<script[^>]*>.*?</script>", ""), (r"<style[^>]*>.*?</style>", ""), (r"<!--.*?-->", ""),
    (r"</(p|div|h1|h2|h3|h4|h5|h6|li|ul|ol|tr|table|section|article|blockquote|nav|header|footer)>|<br[^>]*>", "\n"), (r"<[^>]*>", ""),
):
    _HTML = f"regexp_replace({_HTML}, '{_rx}', '{_to}', 'gis')"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_entity}', '{_char}')"
_HTML = rf"array_to_string(list_filter(list_transform(string_split({_HTML}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \t\r]+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> ''), chr(10))"

_FINDINGS = f"f AS (SELECT doc_id, 'long-paragraph' AS id, 'structure' AS band, 'P2' AS priority, pos FROM ({_LONG_P}) UNION ALL SELECT doc_id, 'long-sentence', 'clarity', 'P1', pos FROM ({_LONG_S}))"
_ALLOWED = "a AS (SELECT doc_id, 'long-sentence' AS id FROM documents WHERE doc_id % 3 = 0 UNION SELECT doc_id, 'long-paragraph' FROM documents WHERE doc_id % 4 = 0)"
_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|\z)', '\1', 'g'), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') || chr(10)"
_ASCII = r"length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))"

SQL: dict[str, str] = {
    "agg_01_doc_stats": f"SELECT * EXCLUDE (source) FROM ({_STATS})",
    "agg_01_trigram_repetition": f"SELECT doc_id, len(g) AS n_trigrams, CASE WHEN len(g) > 0 THEN round((len(g) - len(list_distinct(g))) / len(g)::DOUBLE, 6) ELSE 0.0 END AS trigram_repetition FROM (SELECT doc_id, {_GRAMS.format('w', 3)} AS g FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents))",
    "fun_30_mattr": f"SELECT doc_id, round(list_avg(list_transform(range(1, len(w) - 98), lambda i: len(list_distinct(list_slice(w, i, i + 99))))) / 100, 6) AS mattr FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents) WHERE len(w) >= 100",
    "tok_03_readability": f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w, len({_SENTENCES.format('text')}) AS s FROM documents WHERE lang = 'en'),
      y AS (SELECT doc_id, len(w) AS n, s, list_sum(list_transform(list_transform(w, lambda x: regexp_replace(x, '[^a-z]', '', 'g')), lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN regexp_matches(x, '[^ley]e$') AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))) AS syllables FROM d WHERE len(w) > 0 AND s > 0)
      SELECT doc_id, syllables::INT AS syllables, round(0.39 * (n / s::DOUBLE) + 11.8 * (syllables / n::DOUBLE) - 15.59, 6) AS grade FROM y""",
    "fun_22_ascii_share": r"SELECT lang, count(*) AS docs, sum(length(text))::BIGINT AS chars, round(sum(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))) / sum(length(text))::DOUBLE, 6) AS ascii_share FROM documents GROUP BY lang",
    "agg_03_marker_rates": f"WITH {_COUNTS} SELECT doc_id, marker, n, round(1000.0 * n / words, 6) AS per_1k FROM counts",
    "agg_04_marker_baseline": f"WITH {_BASE} SELECT source, marker, docs, round(mean, 4) AS mean, round(sd, 4) AS sd, round(floored_sd, 4) AS floored_sd FROM base",
    "agg_05_sentence_openers": f"""WITH s AS (SELECT source, unnest({_SENTENCES.format('text')}) AS s FROM documents), g AS (SELECT source, {_WORDS.format('s')}[1] AS word, count(*) AS n FROM s GROUP BY ALL)
      SELECT source, word, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS rank FROM g WHERE word IS NOT NULL QUALIFY rank <= 8""",
    "agg_06_measure_stats": f"WITH {_LONG} SELECT source, measure, count(*) AS n, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0.0), 4) AS sd, round(min(value), 4) AS lo, round(max(value), 4) AS hi FROM m GROUP BY ALL",
    "agg_07_sentence_shape": f"""WITH s AS (SELECT source, unnest({_LENGTHS.format('text')}) AS n FROM documents)
      SELECT source, count(*) AS sentences, {', '.join(f'round(quantile_cont(n, {i / 10}), 4) AS d{i}' for i in range(1, 10))}, round(avg(n), 4) AS mean, round(avg((n <= 8)::INT), 6) AS short_share, round(avg((n >= 30)::INT), 6) AS long_share FROM s GROUP BY source""",
    "agg_08_self_distance": f"WITH {_DELTAS} SELECT source, doc_id, round(delta, 6) AS delta FROM loo",
    "agg_11_voice_distance": f"""WITH {_DELTAS}, band AS (SELECT source AS baseline, max(delta) AS band FROM loo GROUP BY source),
      every AS (SELECT d.source, d.doc_id, b.source AS baseline, sum(least(abs(coalesce(1000.0 * c.n / c.words, 0.0) - b.mean) / b.floored_sd, 4.0)) / {len(MARKERS)} AS delta
        FROM (SELECT source, doc_id FROM documents WHERE lang = 'en' AND len({_WORDS.format("text")}) > 0) d CROSS JOIN base b LEFT JOIN counts c ON c.doc_id = d.doc_id AND c.marker = b.marker GROUP BY ALL)
      SELECT source, doc_id, baseline, round(delta, 6) AS delta, CASE WHEN delta <= band THEN 'in_range' WHEN delta <= 1.5 * band THEN 'near' ELSE 'out_of_range' END AS verdict FROM every JOIN band USING (baseline)""",
    "agg_13_measure_gaps": f"""WITH {_LONG}, b AS (SELECT source, measure, avg(value) AS mean, coalesce(stddev_samp(value), 0.0) AS sd FROM m GROUP BY ALL),
      o AS (SELECT doc_id, measure, round((value - mean) / nullif(greatest(sd, 0.1 * abs(mean)), 0), 4) AS sd_off FROM m JOIN b USING (source, measure)) SELECT doc_id, measure, sd_off, abs(sd_off) <= 2.0 AS within FROM o""",
    "agg_15_presence_rates": "SELECT lang, count(*) AS docs, round(100 * avg(regexp_matches(text, '[0-9]')::INT), 4) AS digit_pct, round(100 * avg(contains(text, chr(10))::INT), 4) AS multiline_pct, round(avg(CASE WHEN length(text) > 0 THEN length(text) END), 4) AS mean_chars, round(quantile_cont(length(text)::DOUBLE, 0.5), 4) AS median_chars FROM documents GROUP BY lang",
    "agg_19_detector_score": """WITH g AS (SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, quality, count(*) AS n, sum(regexp_matches(text, '[#*$%&|<>]')::INT)::BIGINT AS flagged FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang, quality), (quality))),
      p AS (SELECT *, flagged / n::DOUBLE AS rate, 1.96 AS z FROM g)
      SELECT lang, quality, n, flagged, round(rate, 6) AS rate, round((rate + z * z / (2 * n) - z * sqrt(rate * (1 - rate) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS lo, round((rate + z * z / (2 * n) + z * sqrt(rate * (1 - rate) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS hi FROM p""",
    "agg_21_term_profile": f"WITH {_COUNTS}, g AS (SELECT source, marker, count(*) AS docs, sum(n)::BIGINT AS hits FROM counts GROUP BY ALL) SELECT source, marker, docs, hits, row_number() OVER (PARTITION BY source ORDER BY hits DESC, marker) AS rank FROM g QUALIFY rank <= 12",
    "agg_23_ngram_mining": f"""WITH w AS (SELECT {_WORDS.format('text')} AS w FROM conversations WHERE role = 'assistant'),
      a AS ({' UNION ALL '.join(f"SELECT {n} AS n, unnest({_GRAMS.format('w', n)}) AS gram FROM w" for n in (2, 3, 4))}), g AS (SELECT n, gram, count(*) AS hits FROM a GROUP BY ALL)
      SELECT n, gram, hits, row_number() OVER (PARTITION BY n ORDER BY hits DESC, gram) AS rank FROM g QUALIFY rank <= 20""",
    "agg_41_turn_removals": f"""WITH t AS (SELECT conv_id, turn, {_WORDS.format('text')} AS w FROM conversations), p AS (SELECT *, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM t),
      a AS (SELECT conv_id, turn, word, count(*) AS n FROM (SELECT conv_id, turn, unnest(w) AS word FROM p WHERE nxt IS NOT NULL) GROUP BY ALL),
      b AS (SELECT conv_id, turn, word, count(*) AS m FROM (SELECT conv_id, turn, unnest(nxt) AS word FROM p) GROUP BY ALL)
      SELECT conv_id, turn, sum(n - coalesce(m, 0))::BIGINT AS lost, count(*) AS lost_types FROM a LEFT JOIN b USING (conv_id, turn, word) WHERE n > coalesce(m, 0) GROUP BY ALL""",
    "join_02_fact_delta": f"""WITH {_overlaps(f"SELECT min(doc_id) AS id, lines, facts FROM (SELECT doc_id, lines, list_sort({_FACTS.format(_NUMBER)}) AS facts FROM s JOIN documents USING (doc_id)) GROUP BY lines, facts")},
      f AS (SELECT id AS doc_id, facts FROM u),
      a AS (SELECT first_id, doc_id, fact, count(*) AS n FROM (SELECT p.first_id, p.doc_id, unnest(facts) AS fact FROM pairs p JOIN f ON f.doc_id = p.first_id) GROUP BY ALL),
      b AS (SELECT first_id, doc_id, fact, count(*) AS n FROM (SELECT p.first_id, p.doc_id, unnest(facts) AS fact FROM pairs p JOIN f ON f.doc_id = p.doc_id) GROUP BY ALL)
      SELECT first_id, doc_id, 'lost' AS side, fact, a.n - coalesce(b.n, 0) AS n FROM a LEFT JOIN b USING (first_id, doc_id, fact) WHERE a.n > coalesce(b.n, 0)
      UNION ALL SELECT first_id, doc_id, 'added' AS side, fact, b.n - coalesce(a.n, 0) AS n FROM b LEFT JOIN a USING (first_id, doc_id, fact) WHERE b.n > coalesce(a.n, 0)""",
    "join_07_repeated_lines": f"WITH {_LINES}, d AS (SELECT norm, doc_id, count(*) AS k FROM keys GROUP BY ALL) SELECT sha256(norm) AS line_sha, count(*) AS docs, sum(k)::BIGINT AS hits, min(doc_id) AS first_id FROM d GROUP BY norm HAVING count(*) > 1",
    "join_09_overlap": f"""WITH {_OVERLAPS} SELECT doc_id, first_id, common, round(common / smaller::DOUBLE, 6) AS overlap FROM pairs""",
    "join_09_links": f"""WITH {_OVERLAPS}, e AS (SELECT id, count(*) AS links FROM (SELECT doc_id AS id FROM pairs UNION ALL SELECT first_id FROM pairs) GROUP BY id)
      SELECT s.doc_id, u.id AS class_id, coalesce(links, 0) AS links FROM s JOIN u USING (lines) LEFT JOIN e ON e.id = u.id""",
    "join_11_verbatim": f"""WITH d AS (SELECT DISTINCT doc_id, unnest({_GRAMS.format('w', 10)}) AS gram FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)), b AS (SELECT DISTINCT item_id, unnest({_GRAMS.format('w', 10)}) AS gram FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark))
      SELECT doc_id, item_id, count(*) AS windows FROM d JOIN b USING (gram) GROUP BY ALL""",
    "join_13_nearest": """WITH p AS (SELECT q.vec_id, r.vec_id AS other_id, list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)
      SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY d, other_id) AS rank, other_id, round(d, 4) AS distance FROM p QUALIFY rank <= 3""",
    "fun_10_dates": f"""WITH t AS (SELECT o_orderkey, concat('Due ', strftime(o_orderdate, '%B %-d, %Y'), ', sent ', strftime(o_orderdate, '%-d %B %Y'), ' or ', strftime(o_orderdate, '%Y-%m-%d'), '. Not 1234-567.') AS t FROM orders)
      SELECT o_orderkey, array_to_string(list_concat(list_transform(regexp_extract_all(t, '{facts.SPELLINGS[0][0]}'), lambda x: strftime(strptime(x, '%B %-d, %Y'), '%Y-%m-%d')), list_concat(
        list_transform(regexp_extract_all(t, '{facts.SPELLINGS[1][0]}'), lambda x: strftime(strptime(x, '%-d %B %Y'), '%Y-%m-%d')), regexp_extract_all(t, '{facts.SPELLINGS[2][0]}'))), ' ') AS dates FROM t""",
    "fun_12_quotes": r"""WITH t AS (SELECT doc_id, concat('He said "', text, '" and "two words" and ', chr(8220), 'four words  and', chr(10), 'it', chr(8217), 's all', chr(8221), '.') AS t FROM documents),
      q AS (SELECT doc_id, list_transform(regexp_extract_all(t, '"([^"]{0,400})"|' || chr(8220) || '([^' || chr(8221) || ']{0,400})' || chr(8221)), lambda x: trim(regexp_replace(replace(x[2:-2], chr(8217), chr(39)), '[ \t\r\n]+', ' ', 'g'))) AS q FROM t)
      SELECT doc_id, array_to_string(list_filter(q, lambda x: len(string_split(x, ' ')) >= 4), '|') AS quotes FROM q""",
    "fun_13_names": f"""WITH n AS (SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '{_NAMES}', 1), lambda x: length(x) >= 2) AS n FROM documents)
      SELECT doc_id, len(n) AS names, len(list_distinct(n)) AS different, n[1] AS first_name FROM n""",
    "gat_01_turn_names": f"""WITH n AS (SELECT conv_id, turn, role, list_distinct(list_filter(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '{_NAMES}', 1), lambda x: length(x) >= 2)) AS n FROM conversations)
      SELECT b.conv_id, b.turn, len(list_filter(a.n, lambda x: NOT list_contains(b.n, x))) AS lost, len(list_filter(b.n, lambda x: NOT list_contains(a.n, x))) AS added
      FROM n b JOIN n a ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn WHERE b.role = 'assistant' AND a.role <> 'assistant'""",
    "fun_19_digest_dedup": "SELECT doc_id, sha256(text) AS digest, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id, doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) AS kept FROM documents",
    "cvio_trend_events": """WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS a, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS z FROM d)
      SELECT event_type, count(*) AS days, round(avg(n) FILTER (a <= 7), 6) AS early_mean, round(avg(n) FILTER (z <= 7), 6) AS late_mean, round(avg(n) FILTER (z <= 7) / avg(n) FILTER (a <= 7), 6) AS ratio FROM r GROUP BY event_type""",
    "det_13_long_paragraphs": _LONG_P,
    "det_12_long_sentences": _LONG_S,
    "det_06_concealed_spans": r"""WITH c AS (SELECT page_id, regexp_extract_all(html, '(?s)<!--(.*?)-->', 1) AS l FROM pages), s AS (SELECT page_id, unnest(l) AS span, generate_subscripts(l, 1) - 1 AS pos FROM c)
      SELECT page_id, pos, len(list_filter(regexp_split_to_array(span, '[ \t\r\n]+'), lambda x: x <> '')) AS words, len(list_filter(regexp_split_to_array(span, '[ \t\r\n]+'), lambda x: x <> '')) >= 8 AND NOT regexp_matches(span, '""" + detectors.BUILD_MARKER + r"""') AS unexplained FROM s""",
    "src_08_html_text": rf"SELECT page_id, sha256(t) AS text_sha, length(t) AS chars, len(list_filter(regexp_split_to_array(t, '[ \n]+'), lambda x: x <> '')) AS words FROM (SELECT page_id, {_HTML} AS t FROM pages)",
    "agg_02_finding_rollup": f"""WITH f AS (SELECT doc_id, 'long-paragraph' AS id, 'structure' AS band, 'P2' AS priority, pos FROM ({_LONG_P}) UNION ALL SELECT doc_id, 'long-sentence', 'clarity', 'P1', pos FROM ({_LONG_S})),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY pos) AS rn FROM f)
      SELECT coalesce(band, 'all') AS band, coalesce(priority, 'all') AS priority, count(*) AS findings, count(DISTINCT doc_id) AS docs, sum((rn <= 4)::INT)::BIGINT AS shown FROM r GROUP BY ROLLUP (band, priority)""",
    # Digits and the marks between them become spaces one by one where a digit leads the run.
    "prj_01_masked_numbers": r"""WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '[0-9][0-9,.]*') AS hits, regexp_split_to_array(text, '[0-9][0-9,.]*') AS gaps FROM documents),
      m AS (SELECT doc_id, text, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || CASE WHEN i <= len(hits) THEN repeat(' ', length(hits[i])) ELSE '' END), '') AS m, list_sum(list_transform(hits, lambda h: length(h))) AS gone FROM p)
      SELECT doc_id, sha256(m) AS masked_sha, length(m) = length(text) AS same_length, coalesce(gone, 0)::INT AS masked FROM m""",
    "prj_10_first_number": r"""WITH d AS (SELECT doc_id, text, length(regexp_extract(text, '^([^0-9]*)[0-9]', 1)) AS o FROM documents WHERE regexp_matches(text, '[0-9]'))
      SELECT doc_id, o - length(replace(text[1:o], chr(10), '')) + 1 AS line, regexp_replace(regexp_replace(substr(text, greatest(o - 34, 0) + 1, o + 34 - greatest(o - 34, 0)), '[ \t\r\n]+', ' ', 'g'), '^ | $', '', 'g') AS excerpt FROM d""",
    "prj_20_normal_digests": f"SELECT doc_id, sha256({_NORMAL}) AS digest, (length(text) + 2) // 3 AS token_estimate FROM documents",
    "tok_09_paragraphs": f"SELECT * FROM (SELECT doc_id, pos - 1 AS pos, len({_WORDS.format('p')}) AS n FROM (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))) WHERE n BETWEEN 25 AND 220",
    "agg_25_count_marks": "SELECT doc_id, " + ", ".join(f"length(text) - length(replace(text, '{rx[-1]}', '')) AS {name}" for name, rx in lines.MARKS.items()) + " FROM documents",
    "agg_22_count_terms": f"WITH w AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS hits FROM w WHERE list_contains({TERMS!r}, term) GROUP BY term",
    "fun_31_reliability": f"SELECT CASE WHEN n >= 600 THEN 'high' WHEN n >= 250 THEN 'medium' WHEN n >= 120 THEN 'low' ELSE 'insufficient' END AS tier, count(*) AS docs FROM (SELECT len({_WORDS.format('text')}) AS n FROM documents) GROUP BY 1",
    "fun_45_block_burstiness": f"SELECT doc_id, pos - 1 AS pos, round(list_stddev_pop(n) / list_avg(n), 6) AS burstiness FROM (SELECT doc_id, pos, {_LENGTHS.format('p')} AS n FROM (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))) WHERE len(n) >= 3",
    "fun_01_inflections": f"""WITH w AS (SELECT word FROM (SELECT unnest({_WORDS.format('text')}) AS word FROM documents) GROUP BY word HAVING count(*) >= 50)
      SELECT word, CASE WHEN regexp_matches(word, '[^aeiou]y$') THEN word[:-2] || 'ies' WHEN regexp_matches(word, '(s|x|z|ch|sh)$') THEN word || 'es' ELSE word || 's' END AS plural,
        CASE WHEN regexp_matches(word, '[^aeiou]y$') THEN word[:-2] || 'ied' WHEN word LIKE '%e' THEN word || 'd' ELSE word || 'ed' END AS past,
        CASE WHEN word LIKE '%e' AND word NOT LIKE '%ee' THEN word[:-2] || 'ing' ELSE word || 'ing' END AS gerund FROM w""",
    "det_52_ascii_problems": r"""WITH x AS (SELECT doc_id, pos - 1 AS pos FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(line, '[^\x00-\x7F]'))
      SELECT doc_id, pos, greatest(count(*) OVER (PARTITION BY doc_id) - 5, 0) AS more FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 5""",
    "det_19_passives": "SELECT phrase, count(*) AS hits, min(doc_id) AS first_id FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '(?:is|are|was|were|be|been|being) [a-z]+ed')) AS phrase FROM documents) GROUP BY phrase",
    "det_65_picked": f"SELECT sha256({_NORMAL}) AS digest, min(doc_id) AS doc_id FROM documents WHERE len({_WORDS.format('text')}) >= 150 AND {_ASCII} >= 0.95 * length(text) GROUP BY 1",
    "agg_18_event_sequences": """WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), k AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM e WHERE before IS NULL OR before <> event_type)
      SELECT user_id, string_agg(event_type, ' > ' ORDER BY rn) AS sequence FROM k WHERE rn <= 6 GROUP BY user_id""",
    "ord_01_ranked": f"WITH {_FINDINGS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY priority, CASE band WHEN 'clarity' THEN 1 ELSE 2 END, pos, id) AS place, id, pos FROM f QUALIFY place <= 8",
    "join_03_suppressed": f"WITH {_FINDINGS}, {_ALLOWED} SELECT id, a.doc_id IS NOT NULL AS suppressed, count(*) AS n, count(DISTINCT f.doc_id) AS docs FROM f LEFT JOIN a USING (doc_id, id) GROUP BY ALL",
    "join_04_audit": f"WITH {_FINDINGS}, {_ALLOWED} SELECT doc_id, id FROM a EXCEPT SELECT doc_id, id FROM f",
    "join_05_tolerated": f"WITH {_FINDINGS} SELECT lang AS register, id, count(*) AS n FROM f JOIN documents USING (doc_id) WHERE NOT (lang = 'fr' AND id = 'long-paragraph') GROUP BY ALL",
    "join_29_manifest": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'moved' ELSE 'present' END AS status FROM documents",
    "det_01_past_allowance": f"WITH {_FINDINGS} SELECT doc_id, id, pos FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY pos) > 3",
    "agg_20_flagged": f"WITH {_FINDINGS} SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id HAVING bool_or(priority IN ('P0', 'P1'))",
    "agg_12_caricature": f"WITH {_LONG}, b AS (SELECT source, measure, avg(value) AS mean, stddev_samp(value) AS sd FROM m GROUP BY ALL) SELECT doc_id, count(*) AS past, string_agg(measure, ',' ORDER BY measure) AS measures FROM m JOIN b USING (source, measure) WHERE sd > 0 AND abs(value - mean) > 2 * sd GROUP BY doc_id HAVING count(*) >= 2",
    "gat_01_turns": f"""WITH t AS (SELECT conv_id, turn, {_WORDS.format('text')} AS w FROM conversations), p AS (SELECT *, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM t)
      SELECT conv_id, turn, len(w) AS before, len(nxt) AS after, len(list_intersect(w, nxt)) AS shared, len(nxt) * 2 < len(w) AS shrunk FROM p WHERE nxt IS NOT NULL""",
    "str_02_scan": f"SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda p: len({_SENTENCES.format('p')})), lambda n: n > 6)) AS long_paragraphs, len(list_filter({_LENGTHS.format('text')}, lambda n: n > 25)) AS long_sentences FROM documents",
    "str_event_windows": "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL",
    **markdown_catalog.SQL,
    **span_catalog.SQL,
    **span_catalog.prose_sql(_WORDS, _NAMES, _SENTENCES, _MARKERS, _GRAMS, _STATS),
}
