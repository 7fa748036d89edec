"""Readers of prose: text files, preferred READMEs, transcripts, HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text, crlf: a row per file, byte order mark off, line ends as \\n; crlf tells what the file had."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))
    clean = F.regexp_replace(F.regexp_replace("raw", "^﻿", ""), "\r\n?", "\n")
    return d.select("path", clean.alias("text"), F.col("raw").contains("\r\n").alias("crlf"))


def preferred_readmes(files: DataFrame) -> DataFrame:
    """One README of each folder of files (path, text), with the folder's name as `slug`: `.md` before others, then by path.

    Folders of one name in different places are different. Null paths are left out; of repeated rows one stays.
    """
    name = F.element_at(F.split("path", "/"), -1)
    d = files.where(name.rlike("(?i)^readme")).withColumn("slug", F.element_at(F.split("path", "/"), -2))
    choice = F.min_by(F.struct(*d.columns), F.struct(F.when(name.rlike(r"(?i)\.md$"), 0).otherwise(1), "path"))
    return d.groupBy(F.regexp_replace("path", "/[^/]*$", "")).agg(choice.alias("x")).select("x.*")


def assistant_prose(turns: DataFrame, least: int = 4) -> DataFrame:
    """Assistant turns of `least` words or more, code and links out."""
    t = F.regexp_replace(F.regexp_replace("text", r"(?s)```.*?```", " "), r"https?://\S+", " ")
    return turns.where("role = 'assistant'").select("conv_id", "turn", t.alias("text")).where(F.size(T.words(F.col("text"))) >= least)


def pages_as_documents(pages: DataFrame) -> DataFrame:
    """page_id, url and the text of each page's html."""
    return pages.select("page_id", "url", T.html_text(F.col("html")).alias("text"))


def landed_zip(content):
    """True where binary content begins as a zip file does (office documents, e-books)."""
    return F.substring(content, 1, 4) == F.lit(bytes([0x50, 0x4B, 0x03, 0x04]))
