"""Result store: Parquet partitioned by dataset, count and algorithm, so that filters on them prune files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import padded

KEYS = ("dataset", "count", "algo")


def store(results: DataFrame, folder: str, count: int) -> None:
    """Appends rows (dataset, count, algo, run_id, qid, time, neighbors, distances), padded with -1 and infinity."""
    out = results.withColumns({"neighbors": padded(F.col("neighbors"), count, -1), "distances": padded(F.col("distances"), count, float("inf"))})
    out.write.mode("append").partitionBy(*KEYS).parquet(folder)


def scan(spark: SparkSession, folder: str, dataset: str | None = None, count: int | None = None, batch: bool | None = None) -> DataFrame:
    df = spark.read.parquet(folder)
    for name, value in (("dataset", dataset), ("count", count)):
        if value is not None:
            df = df.where(F.col(name) == value)
    if batch is not None:
        df = df.where(F.col("algo").endswith("-batch") if batch else ~F.col("algo").endswith("-batch"))
    return df


def algorithms(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).select("algo").distinct()
