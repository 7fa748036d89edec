"""The document scan and event windows as streams.

The scan is stateless: the same expressions as the batch detectors, row by row, so a file that lands is
scanned once. Windows over events are ours; the reference has no time windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions import text as T


def read_landed(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files that land at path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def scan(docs: DataFrame, most_sentences: int = 6, most_words: int = 25) -> DataFrame:
    """doc_id with the counts of long paragraphs and long sentences; works on streams and tables alike."""
    paragraphs = F.transform(F.split("text", "\n"), lambda p: F.size(T.sentences(p)))
    return docs.select(
        "doc_id",
        F.size(F.filter(paragraphs, lambda n: n > most_sentences)).alias("long_paragraphs"),
        F.size(F.filter(T.sentence_lengths(F.col("text")), lambda n: n > most_words)).alias("long_sentences"),
    )


def scan_to(docs: DataFrame, path: str, checkpoint: str):
    """Starts the scan of a stream into Parquet files, each row exactly once; ends when what has landed is done."""
    return scan(docs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events and their sum of values by type and tumbling window; rows later than `late` are dropped by the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
