"""Allowances, tolerance and gates over findings and pairs of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

from .intervals import free_name

PRIORITY = {"P0": 0, "P1": 1, "P2": 2}
BAND = {"safety": 0, "clarity": 1, "structure": 2}


def ranked(findings: DataFrame) -> DataFrame:
    """Findings with their place in a document's report: priority, band, position, id."""
    rank = lambda c, order: F.coalesce(*(F.when(F.col(c) == k, v) for k, v in order.items()), F.lit(9))
    w = Window.partitionBy("doc_id").orderBy(rank("priority", PRIORITY), rank("band", BAND), "pos", "id")
    return findings.withColumn("place", F.row_number().over(w))


def suppress(findings: DataFrame, allowances: DataFrame) -> DataFrame:
    """findings with `suppressed`: an allowance (doc_id, id) holds and the band isn't safety, which is never suppressed."""
    allowed = free_name("allowed", findings.columns)
    a = allowances.select("doc_id", "id").distinct().withColumn(allowed, F.lit(True))
    d = findings.join(a, ["doc_id", "id"], "left")
    return d.withColumn("suppressed", F.coalesce(F.col(allowed), F.lit(False)) & (F.col("band") != "safety")).drop(allowed)


def audit(findings: DataFrame, allowances: DataFrame) -> DataFrame:
    """Allowances (doc_id, id) that no finding uses."""
    return allowances.select("doc_id", "id").distinct().join(findings, ["doc_id", "id"], "left_anti")


def tolerated(findings: DataFrame, register: DataFrame, skips: DataFrame) -> DataFrame:
    """findings less those whose id the document's register skips: register (doc_id, register), skips (register, id)."""
    d = findings.join(register, "doc_id", "left")
    return d.join(skips, ["register", "id"], "left_anti")


def past_allowance(findings: DataFrame, allowed: int) -> DataFrame:
    """Findings after the first `allowed` of their document and id."""
    place = free_name("place", findings.columns)
    rn = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("pos"))
    return findings.withColumn(place, rn).where(F.col(place) > allowed).drop(place)


def flagged(findings: DataFrame, threshold: str = "P1") -> DataFrame:
    """Documents with a finding at or above a priority, and how many."""
    rank = F.coalesce(*(F.when(F.col("priority") == k, v) for k, v in PRIORITY.items()))
    d = findings.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(rank <= PRIORITY[threshold]).alias("flagged"))
    return d.where("flagged").select("doc_id", "n")


def turn_gate(turns: DataFrame) -> DataFrame:
    """Each turn against the next of its conversation: words before and after, shared types, and whether the text shrank by half."""
    t = turns.select("conv_id", "turn", T.words(F.col("text")).alias("w"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = t.withColumn("next", F.lead("w").over(w)).where("next is not null")
    shared = F.size(F.array_intersect("w", "next"))
    return t.select("conv_id", "turn", F.size("w").alias("before"), F.size("next").alias("after"), shared.alias("shared"), (F.size("next") * 2 < F.size("w")).alias("shrunk"))


def manifest_check(texts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of a manifest (doc_id, sha256) against texts (doc_id, text): present, missing or moved."""
    now = texts.select("doc_id", F.sha2("text", 256).alias("now"))
    status = F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("sha256"), "present").otherwise("moved")
    return manifest.join(now, "doc_id", "left").select("doc_id", status.alias("status"))


def caricature(measures: DataFrame, least: int = 2) -> DataFrame:
    """Documents with `least` measures or more beyond their writer's mean by over two deviations; measures (source, doc_id, measure, value)."""
    b = measures.groupBy("source", "measure").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    d = measures.join(b, ["source", "measure"])
    past = d.where((F.col("sd") > 0) & (F.abs(F.col("value") - F.col("mean")) > 2 * F.col("sd")))
    return past.groupBy("doc_id").agg(F.count("*").alias("past"), F.array_join(F.sort_array(F.collect_list("measure")), ",").alias("measures")).where(F.col("past") >= least)
