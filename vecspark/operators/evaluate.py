"""Quality metrics of search results, Pareto frontiers and the run registry.

truth: rows (qid, rank, distance); found: rows (run_id, qid, distance) in any order. Runs: one row a run.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIE = 1e-10


def _kth(truth: DataFrame, k: int) -> DataFrame:
    return truth.where(F.col("rank") == k).select("qid", F.col("distance").alias("_kth"))


def _hits(found: DataFrame, truth: DataFrame, k: int, within) -> DataFrame:
    near = F.sum(within(F.col("distance"), F.col("_kth")).cast("int"))
    return found.join(_kth(truth, k), "qid").groupBy("run_id", "qid").agg(near.alias("n"))


def recall_knn(found: DataFrame, truth: DataFrame, k: int, n_queries: int) -> DataFrame:
    """(run_id, recall): share of the k neighbours no farther than the true k-th."""
    n = _hits(found, truth, k, lambda d, t: d <= t + TIE)
    return n.groupBy("run_id").agg((F.sum("n") / (n_queries * k)).alias("recall"))


def epsilon_recall(found: DataFrame, truth: DataFrame, k: int, n_queries: int, eps: float) -> DataFrame:
    n = _hits(found, truth, k, lambda d, t: d <= t * (1 + eps))
    return n.groupBy("run_id").agg((F.sum("n") / (n_queries * k)).alias("recall"))


def recall_distribution(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(run_id, n, queries): how many queries have n of their k neighbours, for all n from 0 to k."""
    n = _hits(found, truth, k, lambda d, t: d <= t + TIE)
    counts = n.groupBy("run_id", F.least("n", F.lit(k)).alias("n")).agg(F.count("*").alias("queries"))
    grid = n.select("run_id").distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(k)))).withColumn("n", F.col("n").cast("long"))
    return grid.join(counts, ["run_id", "n"], "left").na.fill(0, ["queries"])


def relative_error(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(run_id, error): sum of found over sum of true distances; infinite if the true sum is below 0.01."""
    true = truth.agg(F.sum("distance").alias("_true"))
    got = found.groupBy("run_id").agg(F.sum("distance").alias("_got"))
    return got.crossJoin(F.broadcast(true)).select("run_id", F.when(F.col("_true") < 0.01, float("inf")).otherwise(F.col("_got") / F.col("_true")).alias("error"))


def set_recall(exact: DataFrame, approx: DataFrame, k: int) -> DataFrame:
    """(src, recall): share of exact neighbours (src, dst) that approx has."""
    hit = exact.select("src", "dst").join(approx.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left")
    return hit.groupBy("src").agg((F.count("hit") / k).alias("recall"))


def pareto_frontier(points: DataFrame, group: str, x: str, y: str, x_best: str = "high", y_best: str = "high") -> DataFrame:
    """Runs that improve x strictly over all runs of better y; rows with x or y = 0 are skipped."""
    xv = F.col(x) if x_best == "high" else -F.col(x)
    yv = F.col(y) if y_best == "high" else -F.col(y)
    before = Window.partitionBy(group).orderBy(F.desc("_y"), F.desc("_x")).rowsBetween(Window.unboundedPreceding, -1)
    df = points.where((F.col(x) != 0) & (F.col(y) != 0)).withColumns({"_x": xv, "_y": yv})
    return df.withColumn("_m", F.max("_x").over(before)).where(F.col("_m").isNull() | (F.col("_x") > F.col("_m"))).drop("_x", "_y", "_m")


def rates(runs: DataFrame) -> DataFrame:
    """Adds qps, size_per_qps from best_search_time and index_size."""
    return runs.withColumn("qps", 1 / F.col("best_search_time")).withColumn("size_per_qps", F.col("index_size") * F.col("best_search_time"))


def best_of(times: DataFrame) -> DataFrame:
    """(run_id, best_search_time, candidates, run_count) of rows (run_id, attempt, time, candidates): the best attempt's mean time."""
    per = times.groupBy("run_id", "attempt").agg(F.avg("time").alias("t"), F.avg("candidates").alias("c"))
    return per.groupBy("run_id").agg(F.min("t").alias("best_search_time"), F.avg("c").alias("candidates"), F.count("*").alias("run_count"))


def missing_runs(definitions: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return definitions.join(done.select(*keys).distinct(), keys, "left_anti")


def parameter_grid(spark, lists: dict[str, list]) -> DataFrame:
    """All combinations of the given values, as strings."""
    rows = [tuple(str(v) for v in c) for c in itertools.product(*lists.values())]
    return spark.createDataFrame(rows, ", ".join(f"`{k}` string" for k in lists))


def check_graph(neighbors: DataFrame, points: DataFrame, distance) -> DataFrame:
    """(src, pos, dst, distance) of neighbour lists (src, neighbors): distances are computed here, not taken from the list."""
    each = neighbors.select("src", F.posexplode("neighbors").alias("pos", "dst"))
    a, b = points.select(F.col("id").alias("src"), F.col("vec").alias("_a")), points.select(F.col("id").alias("dst"), F.col("vec").alias("_b"))
    return each.join(a, "src").join(b, "dst").select("src", "pos", "dst", distance(F.col("_a"), F.col("_b")).alias("distance"))


def all_metrics(found: DataFrame, truth: DataFrame, runs: DataFrame, k: int, n_queries: int, eps: tuple[float, ...] = (0.01, 0.1)) -> DataFrame:
    """One row a run with every metric: recall, epsilon recalls, relative error and the run's rates; runs: (run_id, algo, best_search_time, index_size, ..)."""
    out = rates(runs).join(recall_knn(found, truth, k, n_queries), "run_id", "left")
    for e in eps:
        out = out.join(epsilon_recall(found, truth, k, n_queries, e).withColumnRenamed("recall", f"epsilon_{e}"), "run_id", "left")
    return out.join(relative_error(found, truth), "run_id", "left")


def metric_pairs(metrics: DataFrame, x: str, y: str) -> DataFrame:
    """(algo, points): each algorithm's (x, y, run_id), best y first: the data of a plot of two metrics."""
    return metrics.groupBy("algo").agg(F.sort_array(F.collect_list(F.struct(F.col(y).alias("y"), F.col(x).alias("x"), "run_id")), asc=False).alias("points"))


def sampled(points: DataFrame, n: int, seed: int = 10) -> DataFrame:
    """n points in the order of a seeded hash of their ids, whatever the partitions."""
    return points.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))).orderBy("_h", "id").limit(n).drop("_h")


def recall_histogram(exact: DataFrame, approx: DataFrame, k: int) -> DataFrame:
    """(found, queries): how many points have so many of their k exact neighbours, for all numbers from 0 to k."""
    per = set_recall(exact, approx, k).select(F.round(F.col("recall") * k).cast("int").alias("found"))
    grid = exact.sparkSession.range(k + 1).select(F.col("id").cast("int").alias("found"))
    return grid.join(per.groupBy("found").agg(F.count("*").alias("queries")), "found", "left").na.fill(0, ["queries"])


def by_length(steps: DataFrame) -> DataFrame:
    """(length, points, updates) of rows (length, updates): how often each hash length is used, and its updates."""
    return steps.groupBy("length").agg(F.count("*").alias("points"), F.sum("updates").alias("updates"))


def restricted(definitions: DataFrame, algorithm: str | None = None, tag: str | None = None, run_disabled: bool = False, most: int | None = None) -> DataFrame:
    """The planner's filters over rows (name, algo, tag, disabled): one algorithm, one tag, no disabled ones, the first `most` by name."""
    out = definitions
    if algorithm is not None:
        out = out.where(F.col("algo") == algorithm)
    if tag is not None:
        out = out.where(F.col("tag") == tag)
    if not run_disabled:
        out = out.where(~F.col("disabled"))
    return out if most is None else out.orderBy("name").limit(most)


def padded(values: Column, size: int, fill) -> Column:
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), size)), 1, size)
