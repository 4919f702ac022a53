"""k-NN graph builders: repetitions are a column and run in one job; data-dependent stops are loops over such batches."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.probability import simhash_p
from ..lineage import saved
from . import candidates as C
from .grouped import grouped_topk
from .hashing import CrossPolytope, FHTCrossPolytope, Independent, SimHash, hash_codes, prefix_collision, sketches
from .knn import graph_of, kth_similarity, knn, knn_graph, score_pairs, topk

SKETCHES = 16
BATCH = 16


def family_of(name: str, dim: int, seed: int, rotations: int = 3):
    if name in ("default", "simhash"):
        return SimHash(dim, seed)
    if name == "fht_crosspolytope":
        return FHTCrossPolytope(dim, seed, rotations)
    if name == "crosspolytope":
        return CrossPolytope(dim, seed)
    raise ValueError(f"unknown hash function {name!r}")


def _dim(points: DataFrame) -> int | None:
    row = points.select(F.size("vec").alias("d")).head()
    return row["d"] if row else None


def _with_sketches(hashes: DataFrame, points: DataFrame, dim: int, bits: int, kth: DataFrame | None, seed: int) -> DataFrame:
    """Adds the sketch that the table's turn has, and each point's threshold from its k-th similarity."""
    sk = sketches(points, dim, SKETCHES, 1, seed + 77).select("id", "sketch_no", F.col("w0").alias("sk"))
    thr = F.lit(64) if kth is None else F.floor(64 * (1 - simhash_p(F.col("kth")))).cast("int")
    out = hashes.withColumn("sketch_no", F.pmod("table_id", F.lit(SKETCHES))).join(sk, ["id", "sketch_no"]).drop("sketch_no")
    return out.withColumn("thr", thr) if kth is None else out.join(kth, "id").withColumn("thr", thr)


def _near(a: dict, b: dict):
    """Sketch filter: at most the larger of both thresholds of differing bits."""
    return np.bitwise_count((a["sk"] ^ b["sk"]).view(np.uint64)) <= np.maximum(a["thr"], b["thr"])


def _grown(edges: DataFrame | None, found: DataFrame, k: int) -> DataFrame:
    """The graph of the edges so far and those found."""
    return saved(topk(found if edges is None else found.unionByName(edges.select("src", "dst", "sim")), k))


def _columns(hashes: DataFrame, *more: str) -> tuple[str, ...]:
    return tuple(c for c in ("sk", "thr", "kth", *more) if c in hashes.columns)


def _codes(points: DataFrame, dim: int, reps: int, bits: int, seed: int, hash_function: str = "default", rotations: int = 3) -> DataFrame:
    return hash_codes(points.select("id", "vec"), family_of(hash_function, dim, seed, rotations), Independent(reps, bits))


def _in_batches(points: DataFrame, k: int, reps: int, bits: int, seed: int, use_sketching: bool, pairs) -> DataFrame:
    """Fixed repetitions. Without sketches one job; with them thresholds tighten from batch to batch."""
    dim = _dim(points)
    if not use_sketching:
        return graph_of(score_pairs(pairs(_codes(points, dim, reps, bits, seed), False), points), k)
    edges = None
    for at in range(0, reps, BATCH):
        n = min(BATCH, reps - at)
        kth = None if edges is None else kth_similarity(edges, points, k)
        h = _with_sketches(_codes(points, dim, n, bits, seed + at), points, dim, bits, kth, seed)
        edges = saved(graph_of(score_pairs(pairs(h, True), points), k, edges))
    return edges


def fixed_buckets(points: DataFrame, k: int, repetitions: int = 100, hash_length: int = 16, bucket_size: int = 16, use_sketching: bool = True, use_graycodes: bool = False, seed: int = 21) -> DataFrame:
    return _in_batches(points, k, repetitions, hash_length, seed, use_sketching, lambda h, sk: C.block_pairs(h, bucket_size, hash_length, use_graycodes, sk))


def bounded_buckets(points: DataFrame, k: int, repetitions: int = 100, hash_length: int = 16, bucket_size: int = 32, use_sketching: bool = True, seed: int = 22) -> DataFrame:
    return _in_batches(points, k, repetitions, hash_length, seed, use_sketching, lambda h, sk: C.bounded_pairs(h, bucket_size, hash_length, sk))


def projection_weights(reps: int, bits: int, seed: int) -> dict[int, list[float]]:
    """Unit projections of hash bits, with three decimals so that sums are the same everywhere."""
    rng = random.Random(seed)
    return {t: [round(rng.gauss(0, 1), 3) for _ in range(bits)] for t in range(reps)}


def projection(points: DataFrame, k: int, repetitions: int = 100, hash_length: int = 16, block_size: int = 16, use_sketching: bool = True, seed: int = 23) -> DataFrame:
    if hash_length > (_dim(points) or hash_length):
        raise ValueError("hash_length must not be larger than the dimensions")
    weights = projection_weights(repetitions, hash_length, seed + 1)
    return _in_batches(points, k, repetitions, hash_length, seed, use_sketching, lambda h, sk: C.projection_pairs(h, weights, block_size, sk))


def plain(points: DataFrame, k: int, recall: float = 0.5, hash_length: int = 16, use_sketching: bool = True, seed: int = 24, most: int = 4096) -> DataFrame:
    """Fresh hashes until the average over points of 1 - (1 - p(kth)) ** reps reaches the recall."""
    dim, edges, reps = _dim(points), None, 0
    while reps < most:
        kth = None if edges is None else kth_similarity(edges, points, k)
        h = _codes(points, dim, BATCH, hash_length, seed + reps)
        if use_sketching:
            h = _with_sketches(h, points, dim, hash_length, kth, seed)
        rows = h.withColumns({"left": F.lit(True), "right": F.lit(True)})
        edges = _grown(edges, grouped_topk(rows, points, k, ["table_id", "h"], extra=_columns(h), keep=_near if use_sketching else None), k)
        reps += BATCH
        p = F.pow(simhash_p(F.col("kth")), F.lit(float(hash_length)))
        if kth_similarity(edges, points, k).agg(F.avg(1 - F.pow(1 - p, F.lit(float(reps))))).first()[0] >= recall:
            return edges
    # still below the recall: the rest is searched exactly
    rest = knn(points, points, k, exclude_self=True)
    return graph_of(rest.select(F.col("src").alias("i"), F.col("dst").alias("j"), "sim"), k, edges)


def varying_repetitions(points: DataFrame, k: int, recall: float = 0.8, keep_points: bool = True, guaranteed_fraction: float = 0.9, update_treshold: float = 50, initial_hash_length: int = 24, hash_function: str = "default", num_rotations: int = 3, use_sketching: bool = True, seed: int = 25, most: int = 8) -> DataFrame:
    """Shorter and shorter hashes; points whose neighbours are found with the recall are frozen and stop meeting each other."""
    dim, n = _dim(points), points.count()
    family = family_of(hash_function, dim, seed, num_rotations)
    live_least = (1 - guaranteed_fraction) * n
    reps: dict[int, int] = {}
    edges = None
    frozen = points.select("id").withColumn("frozen", F.lit(False))
    live, step = n, 0
    for length in range(initial_hash_length, 0, -1):
        if live <= live_least:
            break
        for _ in range(most):
            batch = BATCH
            step += 1
            h = _codes(points, dim, batch, length, seed + 1000 * step, hash_function, num_rotations)
            if use_sketching:
                kth = None if edges is None else kth_similarity(edges, points, k)
                h = _with_sketches(h, points, dim, length, kth, seed)
            h = h.join(frozen, "id")
            sized = h.groupBy("table_id", "h").agg(F.sum((~F.col("frozen")).cast("long")).alias("a"), F.sum(F.col("frozen").cast("long")).alias("b"))
            updates = sized.agg(F.sum(F.col("a") * (F.col("a") - 1) / 2 + F.col("a") * F.col("b"))).first()[0] or 0
            # each pair has a live row, whose bucket it is found from
            rows = h.withColumns({"left": ~F.col("frozen"), "right": F.lit(True)})
            rows = rows if keep_points else rows.where("left")
            edges = _grown(edges, grouped_topk(rows, points, k, ["table_id", "h"], extra=_columns(h), keep=_near if use_sketching else None, both=True), k)
            reps[length] = reps.get(length, 0) + batch
            miss = F.lit(1.0)
            for b, r in reps.items():
                miss = miss * F.pow(1 - prefix_collision(family, F.col("kth"), b), F.lit(float(r)))
            frozen = saved(kth_similarity(edges, points, k).select("id", ((1 - miss) >= recall).alias("frozen")))
            live = frozen.where("not frozen").count()
            if live <= live_least or updates <= update_treshold * live * batch:
                break
    if live > live_least:
        # no bits at all: one bucket, so the live points meet all others
        rest = knn(points.join(frozen.where("not frozen"), "id", "left_semi"), points, k, exclude_self=True)
        edges = saved(graph_of(rest.select(F.col("src").alias("i"), F.col("dst").alias("j"), "sim"), k, edges))
    return edges


def nndescent(points: DataFrame, k: int, repetitions: int = 20, sample_rate: float = 1.0, use_sketching: bool = False, seed: int = 26) -> DataFrame:
    """Random start, then rounds of local joins. With sketching a pair is only scored if its sketches differ in no more
    bits than expected at the k-th similarity of one of both; each round uses the next sketch."""
    dim = _dim(points)
    sk = saved(sketches(points, dim, SKETCHES, 1, seed + 77)) if use_sketching else None
    start = C.random_pairs(points, k, seed).select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"))
    edges = saved(graph_of(score_pairs(start, points), k))
    for number in range(repetitions):
        if sk is None:
            # all neighbours of a node meet in place
            rows = C.descent_neighbours(edges, k, sample_rate).withColumns({"left": F.lit(True), "right": F.lit(True)}).withColumnRenamed("v", "id")
            before, edges = edges, _grown(edges, grouped_topk(rows, points, k, ["c"]), k)
            if edges.join(before, ["src", "dst"], "left_anti").isEmpty():  # all further rounds give the same
                break
            continue
        pairs = C.descent_pairs(edges, k, sample_rate)
        thr = F.floor(64 * (1 - simhash_p(F.col("kth")))).cast("int").alias("thr")
        side = sk.where(F.col("sketch_no") == number % SKETCHES).join(kth_similarity(edges, points, k).select("id", thr), "id")
        one, two = (side.select(F.col("id").alias(c), F.col("w0").alias(f"s{c}"), F.col("thr").alias(f"t{c}")) for c in "ij")
        pairs = pairs.join(one, "i").join(two, "j").where(F.bit_count(F.col("si").bitwiseXOR(F.col("sj"))) <= F.greatest("ti", "tj")).select("i", "j")
        edges = saved(graph_of(score_pairs(pairs, points), k, edges))
    return edges


def equal_length(kth: Column, success: float, bits: int) -> Column:
    """Hash length at which a point's k-th neighbour is met with the success probability; the scan goes one way, hence twice."""
    p = simhash_p(kth)
    n = F.round(F.log(F.lit(min(1.0, 2 * success))) / F.log(F.when((p > 0) & (p < 1), p)))
    return F.greatest(F.lit(0), F.least(F.lit(bits), F.coalesce(n, F.when(p >= 1, F.lit(bits)).otherwise(0)).cast("int")))


def equal_failure_prob(points: DataFrame, k: int, recall: float = 0.5, hash_length: int = 24, success_prob: float = 0.1, use_sketching: bool = True, seed: int = 27) -> DataFrame:
    """Each point's own hash length, for as many repetitions as the recall needs."""
    dim = _dim(points)
    edges = saved(graph_of(score_pairs(C.block_pairs(_codes(points, dim, 1, hash_length, seed), k + 1, hash_length), points), k))
    for rep in range(math.ceil(math.log(1 - recall) / math.log(1 - success_prob))):
        kth = kth_similarity(edges, points, k)
        lens = kth.select("id", equal_length(F.col("kth"), success_prob, hash_length).alias("len"))
        h = _codes(points, dim, 1, hash_length, seed + 1 + rep)
        if use_sketching:
            h = _with_sketches(h, points, dim, hash_length, kth, seed)
        edges = _grown(edges, _varying_topk(h.join(lens, "id"), points, k, hash_length, use_sketching), k)
    return edges


def _varying_topk(hashes: DataFrame, points: DataFrame, k: int, bits: int, sketched: bool) -> DataFrame:
    """The k best partners of each row by the pairs of candidates.varying_pairs."""
    lens = hashes.select("len").distinct().withColumnRenamed("len", "_len")  # at most bits + 1 rows
    rows = hashes.crossJoin(F.broadcast(lens)).withColumn("prefix", F.expr(f"shiftright(h, {bits} - _len)"))
    rows = rows.withColumns({"left": F.col("len") == F.col("_len"), "right": F.lit(True)})

    def keep(a: dict, b: dict):
        after = (b["h"] > a["h"]) | ((b["h"] == a["h"]) & (b["id"] > a["id"]))
        return after & _near(a, b) if sketched else after

    return grouped_topk(rows, points, k, ["table_id", "_len", "prefix"], extra=_columns(hashes, "h"), keep=keep, both=True)


METHODS = {"plain": plain, "varying_repetitions": varying_repetitions, "fixed_buckets": fixed_buckets, "bounded_buckets": bounded_buckets, "projection": projection, "nndescent": nndescent, "equal_failure_prob": equal_failure_prob}


def build_graph(metric: str, points: DataFrame, k: int, method: str = "plain", **options) -> DataFrame:
    """Rows (src, dst, sim, rank) of the graph of points (id, vec); method brute_force is exact. Empty in, empty out."""
    if metric != "angular":
        raise ValueError(f"unsupported metric {metric!r}")
    if method == "brute_force":
        return knn_graph(points, k)
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if method != "varying_repetitions" and options.pop("hash_function", "default") != "default":
        raise ValueError("hash_function is only for varying_repetitions")
    if k == 0 or _dim(points) is None:
        return points.sparkSession.createDataFrame([], "src long, dst long, sim double, rank int")
    return METHODS[method](points, k, **options)
