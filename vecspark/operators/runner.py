"""Benchmark runs: fit, query, measure, best of several."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .adapters import instantiate
from .knn import adjacency


def run(name: str, points: DataFrame, queries: DataFrame, k: int, dataset: str, repeats: int = 2, **options) -> DataFrame:
    """Rows for the result store; all queries are one batch, its best time of `repeats` is shared equally among them."""
    began = time.time()
    algorithm = instantiate(name, **options).fit(points)
    build = time.time() - began
    best, rows = float("inf"), None
    n = max(1, queries.count())
    for _ in range(repeats):
        began = time.time()
        if rows is not None:
            rows.unpersist()
        rows = algorithm.query(queries, k).cache()
        rows.count()
        best = min(best, (time.time() - began) / n)
    lists = adjacency(rows).join(rows.groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "sim"))), lambda x: 1 - x["sim"]).alias("distances")), "src")
    return lists.select(F.lit(dataset).alias("dataset"), F.lit(k).alias("count"), F.lit(name).alias("algo"), F.lit(f"{name}-{k}").alias("run_id"), F.col("src").alias("qid"), F.lit(best).alias("time"), F.lit(build).alias("build_time"), "neighbors", "distances")
