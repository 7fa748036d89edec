"""What operators share: reliable checkpoints, so that a round's plan doesn't hold those of all before, and Arrow batches in pieces."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint; without a folder for it, one is made in local mode, and on a cluster it is an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()


def pieces(batches, rows: int = 128):
    """Arrow batches in pieces of a few rows, so that what Python makes of them is held for these alone."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
