"""Helpers that several operators share: scratch tables, size-checked broadcasts, running totals, components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes (about, in memory) up to which a side of a join may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 64 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset, a new local one if Spark runs in one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Bytes of an Arrow batch between Spark and Python; Spark's own default holds 64 MB of texts in each task.
BATCH, _SETTING = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold at most BATCH bytes, where it had Spark's default."""
    conf = df.sparkSession.conf
    if conf.get(_SETTING) == f"{64 << 20}b":  # Spark's default
        conf.set(_SETTING, BATCH)
    return df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = bounded(df).sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _width(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value in memory, about."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.octet_length(column) + 16
    if isinstance(kind, T.ArrayType):
        each = F.lit(8 if isinstance(kind.elementType, T.NumericType) else 48)
        return F.coalesce(F.size(column), F.lit(0)) * each + 16
    return F.lit(16)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if a scan shows at most `rows` rows and `size` bytes, else as it is: a shuffle join.

    A side that stays is joined by shuffle, and Spark's adaptive plans split the rows of a hot key there. df is computed
    for the scan, so pass a table that was read or materialized.
    """
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    found = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if found[0] <= rows and found[1] <= size else df


def wrapped(docs: DataFrame, **keys: Column) -> DataFrame:
    """docs as one column `row`, so that no name of theirs clashes, with the columns that keys names."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in keys.items()))


def readable(name: str) -> Column:
    """The column as a string in which U+FFFD stands for bytes that are no UTF-8."""
    return F.make_valid_utf8(F.col(name).cast("string"))


def running_total(df: DataFrame, key: str, value: str, out: str, *ties: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows with a smaller `key`, in one global order.

    Rows are range-partitioned by key and then by `ties`, which spread many rows of one key; each partition is summed, and only one row per
    partition takes part in the sum over partitions. Ties of all these get consecutive totals.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in (key, *ties)]
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("__part").agg(F.sum(value).alias("__sum"))
    # One row per partition, so the single window below is as small as the partition count.
    before = F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return (
        ranged.join(F.broadcast(sums), "__part")
        .withColumn(out, (F.col("__before") + F.coalesce(within, F.lit(0))).cast("long"))
        .drop("__part", "__before")
    )


def components(edges: DataFrame, a: str, b: str, name: str = "links") -> DataFrame:
    """Distributed union-find: rows (node, root) for every node of the edges, root the least node of its component.

    In each round every node points at its least neighbour, pointers are followed until all
    reach a root, and the edges are drawn anew between roots; a round at least halves what is
    left of a component. Joins read tables in the shared folder on both sides, so that Spark can
    split the rows of a hub.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    labels = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("p")), name)
        while True:
            above = up.select(F.col("u").alias("p"), F.col("p").alias("top"))
            up = materialize(up.join(above, "p").select("u", F.col("top").alias("p"), (F.col("top") != F.col("p")).alias("moved")), name)
            if up.where("moved").isEmpty():
                break
            up = up.drop("moved")
        up = up.drop("moved")
        if labels is None:
            labels = up
        else:
            labels = labels.join(up.select(F.col("u").alias("p"), F.col("p").alias("top")), "p", "left").select("u", F.coalesce("top", "p").alias("p"))
        for end in ("u", "v"):
            e = e.join(up.select(F.col("u").alias(end), F.col("p").alias("top")), end).drop(end).withColumnRenamed("top", end)
        e = materialize(e.where("u <> v").distinct(), name)
        if e.isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("p").alias("root"))


#: Rows and bytes of text that a task takes up at once.
ROWS, BYTES = 4096, 8 << 20


def parts(batches, column: str = "text", rows: int = ROWS, size: int = BYTES):
    """Arrow batches in slices of at most `rows` rows and about `size` bytes of the column (one row at least)."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy())
        at = 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            end = max(at + 1, min(at + rows, int(np.searchsorted(upto, before + size, "right"))))
            yield batch.slice(at, end - at)
            at = end


def texts(batches, column: str = "text", size: int = 256):
    """(batch, bytes of the column or None by row) for slices of at most `size` rows."""
    for part in parts(batches, column, size):
        yield part, part.column(part.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
