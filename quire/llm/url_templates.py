"""URL filter by a path-template tree.

Fixed rules come first: the longest rule (host and path prefix) that fits a url decides. All other
urls are judged by the template of their path:

1. Segments of a typed shape (numbers, hex ids, dates, file names with digits) become typed wildcards.
2. Level by level under each host, a literal segment becomes `*` if its parent has many children
   and the segment holds no more than its even share: a variable place, such as a slug.
3. Literal siblings of at least LEAST labels are laid in bins of their bad rate, and neighbouring bins are joined while the next
   doesn't differ from those joined so far (two-proportion z test). Each set of two or more siblings becomes `*1`, `*2`, ... in order
   of its rate. Siblings with fewer labels stay as they are: too little evidence is no similarity.
4. A template is rejected if its smoothed purity is below PURITY. A template's bad rate is drawn to
   its host's by WEIGHT pseudo-labels, and a host's to that of all urls.

Everything runs on counts per (host, typed path), joined back by equality. Paths of any depth are told apart; one that
shares its parent with no other path has nothing left to merge and leaves the levels.

Null urls and those without `://` have empty host and path and are allowed. Repeated rows and null page_ids are
returned as they come. Without labels all templates are allowed. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

#: (verdict, host, path)
Rule = tuple[str, str, str]
BRANCHES, LEAST, BINS, Z, WEIGHT, PURITY = 24, 5, 64, 1.96, 10.0, 0.7
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first :// to /, ?, # or the end, in lower case; path: from there to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _typed(segment: Column) -> Column:
    return (
        F.when(segment.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "<date>")
        .when(segment.rlike(r"^[0-9]+$"), "<num>")
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z]{1,5}$"), F.concat(F.lit("<num>"), F.regexp_extract(segment, r"(\.[A-Za-z]+)$", 1)))
        .when(segment.rlike(r"^[0-9a-fA-F-]{16,}$"), "<hex>")
        .when(segment.rlike(r"[0-9].*[0-9].*[0-9]"), "<mixed>")
        .otherwise(segment)
    )


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits; null without one."""
    rule = verdict = None
    for said, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _alike(a: Column, b: Column) -> Column:
    """Whether two counts (labelled, bad), each with a pseudo-label of either kind, don't differ by a two-proportion z test."""
    m, n = a["labelled"] + 2, b["labelled"] + 2
    p, q = (a["bad"] + 1) / m, (b["bad"] + 1) / n
    pooled = (a["bad"] + b["bad"] + 2) / (m + n)
    return F.abs(p - q) < Z * F.sqrt(pooled * (1 - pooled) * (1 / m + 1 / n))


def _sets(bins: Column) -> Column:
    """Sorted bins (bin, labelled, bad, branches) of one parent to sets (upto, labelled, bad, branches) of bins that are alike."""
    kind = "array<struct<upto:int,labelled:bigint,bad:bigint,branches:bigint>>"

    def join(sets, x):
        last = F.get(sets, F.size(sets) - 1)
        both = (F.coalesce(last[c], F.lit(0)) + x[c] for c in ("labelled", "bad", "branches"))
        grown = F.concat(F.slice(sets, 1, F.greatest(F.size(sets) - 1, F.lit(0))), F.array(F.struct(x["bin"], *both)).cast(kind))
        return F.when((F.size(sets) > 0) & _alike(last, x), grown).otherwise(F.concat(sets, F.array(x).cast(kind)))

    return F.aggregate(bins, F.array().cast(kind), join)


def _merged(literal: DataFrame) -> DataFrame:
    """host, parent, branch and its wildcard for the literal branches (host, parent, branch, n, labelled, bad) to merge."""
    parents = literal.groupBy("host", "parent").agg(F.count("*").alias("branches"), F.sum("n").alias("all_n")).where("branches > 1")
    judged = literal.join(small(materialize(parents, "parents")), ["host", "parent"])
    variable = (F.col("branches") > BRANCHES) & (F.col("n") * F.col("branches") <= 2 * F.col("all_n"))
    rate = (F.col("bad") + 1) / (F.col("labelled") + 2)
    judged = materialize(judged.withColumn("variable", variable).withColumn("bin", (rate * BINS).cast("int")), "judged")
    seen = (F.col("labelled") >= LEAST) & ~F.col("variable")
    bins = judged.where(seen).groupBy("host", "parent", "bin").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count("*").alias("branches"))
    # At most BINS rows of a parent, however many branches it has.
    sets = bins.groupBy("host", "parent").agg(_sets(F.array_sort(F.collect_list(F.struct("bin", "labelled", "bad", "branches")))).alias("sets"))
    found = judged.join(small(materialize(sets, "sets")), ["host", "parent"], "left")
    number = F.size(F.filter("sets", lambda x: x["upto"] < F.col("bin")))
    wildcard = F.when(F.col("variable"), "*").when(seen & (F.get("sets", number)["branches"] > 1), F.concat(F.lit("*"), (number + 1).cast("string")))
    return materialize(found.select("host", "parent", "branch", wildcard.alias("wildcard")).where("wildcard is not null"), "merged")


def templates(paths: DataFrame) -> DataFrame:
    """host, segments and template (an array) of every row of paths (host, segments, n, labelled, bad).

    Level by level; a level takes only the paths that still share a parent with another, so there are as many as two
    paths have segments in common.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    t, done, d = paths.withColumn("template", F.col("segments")), None, 0
    while True:
        d += 1
        t = t.withColumn("parent", F.slice("template", 1, d - 1))
        shared = t.groupBy("host", "parent").agg(F.count("*").alias("c"), F.max(F.size("segments")).alias("deepest"))
        shared = small(materialize(shared.select("host", "parent", ((F.col("c") > 1) & (F.col("deepest") >= d)).alias("shared")), "shared"))
        t = materialize(t.join(shared, ["host", "parent"]), "level")
        left = t.where(~F.col("shared") | (F.size("template") < d)).drop("parent", "shared")
        done = left if done is None else done.unionByName(left)
        t = t.where(F.col("shared") & (F.size("template") >= d)).drop("shared").withColumn("branch", F.get("template", F.lit(d - 1)))
        if t.isEmpty():
            return materialize(done, "tree")
        branches = t.groupBy("host", "parent", "branch").agg(*sums)
        merged = _merged(branches.where(~F.col("branch").rlike(r"^[<*]")))
        t = t.join(small(merged), ["host", "parent", "branch"], "left")
        whole = F.concat("parent", F.array("wildcard"), F.slice("template", d + 1, F.size("template")))
        t = t.withColumn("template", F.when(F.col("wildcard").isNotNull(), whole).otherwise(F.col("template")))
        t = materialize(t.drop("parent", "branch", "wildcard"), "tree")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[Rule], purity: float = PURITY) -> DataFrame:
    """page_id, host, path, rule, verdict and template for every row of pages (page_id, url).

    labels (quality, toxic, and page_id, url or doc_id) holds for the pages with its page_id or url, or else, as an assumption, for the
    urls whose last number is its doc_id. A url of bad quality or toxic is bad.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = rows.withColumn("segments", F.transform(segments, _typed))
    by = next(c for c in ("page_id", "url", "doc_id") if c in labels.columns)
    own = {"page_id": F.col("page_id"), "url": F.col("url"), "doc_id": F.expr("try_cast(regexp_extract(path, '([0-9]{1,18})[^0-9]*$', 1) as long)")}
    rows = rows.withColumn("label_key", own[by].cast("string"))
    known = labels.where(F.col(by).isNotNull()).groupBy(F.col(by).cast("string").alias("label_key")).agg(F.max(((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("is_bad"))
    counted = rows.where("host <> ''").join(small(materialize(known, "known")), "label_key", "left").groupBy("host", "segments")
    counted = counted.agg(F.count("*").alias("n"), F.count("is_bad").alias("labelled"), F.coalesce(F.sum("is_bad"), F.lit(0)).alias("bad"))
    tree = templates(materialize(counted, "paths"))

    sums = [F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]
    by_template = materialize(tree.groupBy("host", "template").agg(*sums), "by_template")
    by_host = by_template.groupBy("host").agg(*(F.sum(c).alias("host_" + c) for c in ("labelled", "bad")))
    total = by_template.agg(*sums).first()
    base = (total["bad"] or 0) / total["labelled"] if total["labelled"] else 0.0
    host_rate = (F.col("host_bad") + WEIGHT * base) / (F.col("host_labelled") + WEIGHT)
    rate = (F.col("bad") + WEIGHT * host_rate) / (F.col("labelled") + WEIGHT)
    rated = by_template.join(small(materialize(by_host, "by_host")), "host").select("host", "template", (1 - rate).alias("purity"))
    named = tree.select("host", "segments", "template").join(small(materialize(rated, "rated")), ["host", "template"])
    named = materialize(named.select("host", "segments", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity"), "named")
    out = rows.join(small(named), ["host", "segments"], "left")
    learned = F.when(F.col("purity") < purity, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "template", "purity")
