"""Lineage cuts for iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """Checkpoints to the session's spark.checkpoint.dir; a temporary folder only where that is unset (one machine)."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("a cluster needs a shared folder: set spark.checkpoint.dir")
            folder = tempfile.mkdtemp(prefix="vecspark-")
        spark.sparkContext.setCheckpointDir(folder)
    out = df.checkpoint(eager=True)
    # loops make many plans and shuffles; the driver gives back the heap and the shuffle files of those that are done
    spark.sparkContext._jvm.System.gc()
    return out
