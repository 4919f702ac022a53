"""Exact nearest neighbours as blocked similarity joins, and top-k per group.

Both sides are packed into blocks of rows; pairs of blocks meet in tasks that score with one matrix product and keep
the k best a row, so what leaves a task is rows * k and not all pairs. A window then keeps the k best overall (ties:
the larger id first). Similarities are rounded to DIGITS so that ties do not depend on the order of sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import saved
from .hashing import matrix

BLOCK = 1024
DIGITS = 9
#: Ids of equal sets in one list.
MEMBERS = 1024


def topk(edges: DataFrame, k: int, by: str = "src", other: str = "dst", sim: str = "sim") -> DataFrame:
    """The k best of each `by` with their rank from 1; a similarity of 0 never counts, repeated pairs count once."""
    w = Window.partitionBy(by).orderBy(F.desc(sim), F.desc(other))
    best = edges.where(F.col(sim) > 0).dropDuplicates([by, other])
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def adjacency(edges: DataFrame) -> DataFrame:
    """Neighbour lists, best first."""
    return edges.groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"]).alias("neighbors"))


def kth_similarity(edges: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(id, kth): the similarity at rank k, 0 with fewer than k neighbours."""
    kth = edges.where(F.col("rank") == k).select(F.col("src").alias("id"), F.col("sim").alias("kth"))
    return points.select("id").join(kth, "id", "left").na.fill(0.0, ["kth"])


def scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Similarities (larger is closer) of all rows of a and b."""
    if metric in ("angular", "cosine"):
        na, nb = np.linalg.norm(a, axis=1, keepdims=True), np.linalg.norm(b, axis=1, keepdims=True)
        s = (a / np.where(na > 0, na, 1)) @ (b / np.where(nb > 0, nb, 1)).T
        out = (s + 1) / 2
    elif metric in ("euclidean", "l2"):
        d = (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :]
        out = 1 / (1 + np.maximum(d, 0))
    elif metric == "hamming":
        ba, bb = (a > 0).astype(np.float64), (b > 0).astype(np.float64)
        out = 1 - (ba @ (1 - bb).T + (1 - ba) @ bb.T) / a.shape[1]
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return np.round(out, DIGITS)


def blocks(df: DataFrame, prefix: str) -> DataFrame:
    """Rows (id, vec) packed BLOCK at a time: ids and vectors as bytes, and the dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                m = matrix(part.column(1))
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()]), pa.array([m.tobytes()]), pa.array([m.shape[1]], pa.int32())], names=[f"{prefix}_ids", f"{prefix}_vecs", f"{prefix}_dim"])

    return df.select("id", "vec").mapInArrow(run, f"{prefix}_ids binary, {prefix}_vecs binary, {prefix}_dim int")


def knn(queries: DataFrame, data: DataFrame, k: int, metric: str = "angular", exclude_self: bool = False) -> DataFrame:
    """Rows (src, dst, sim, rank): the k nearest rows of data (id, vec) for each row of queries (id, vec)."""
    both = blocks(queries, "q").crossJoin(blocks(data, "x"))  # of blocks, not of rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, qv, qd, xi, xv, xd in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                q, x = np.frombuffer(qi, np.int64), np.frombuffer(xi, np.int64)
                s = scores(np.frombuffer(qv).reshape(-1, qd), np.frombuffer(xv).reshape(-1, xd), metric)
                if exclude_self:
                    s[q[:, None] == x[None, :]] = 0
                order = np.argsort(-x, kind="stable")  # of equal similarities the larger id stands first
                best = order[np.argsort(-s[:, order], axis=1, kind="stable")[:, :k]]
                sim = np.take_along_axis(s, best, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, best.shape[1])), pa.array(x[best].reshape(-1)), pa.array(sim.reshape(-1))], names=["src", "dst", "sim"])

    return topk(both.mapInArrow(run, "src long, dst long, sim double"), k)


def knn_graph(points: DataFrame, k: int, metric: str = "angular") -> DataFrame:
    """The exact k-NN graph of rows (id, vec)."""
    return knn(points, points, k, metric, exclude_self=True)


def score_pairs(pairs: DataFrame, points: DataFrame, metric: str = "angular", others: DataFrame | None = None) -> DataFrame:
    """Rows (i, j, sim) for distinct pairs (i, j); vectors are joined on only here, those of j from others if given."""
    left, right = points.select(F.col("id").alias("i"), F.col("vec").alias("_vi")), (points if others is None else others).select(F.col("id").alias("j"), F.col("vec").alias("_vj"))
    joined = pairs.select("i", "j").distinct().join(left, "i").join(right, "j").select("i", "j", "_vi", "_vj")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = matrix(b.column(2)), matrix(b.column(3))
            if metric in ("angular", "cosine"):
                n = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
                s = ((x * y).sum(axis=1) / np.where(n > 0, n, 1) + 1) / 2
            elif metric in ("euclidean", "l2"):
                s = 1 / (1 + ((x - y) ** 2).sum(axis=1))
            else:
                s = 1 - ((x > 0) != (y > 0)).mean(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(s, DIGITS))], names=["i", "j", "sim"])

    return joined.mapInArrow(run, "i long, j long, sim double")


def graph_of(scored: DataFrame, k: int, previous: DataFrame | None = None) -> DataFrame:
    """Top-k graph of scored pairs (i, j, sim), each used both ways, with the edges found before."""
    edges = scored.select(F.col("i").alias("src"), F.col("j").alias("dst"), "sim").unionByName(scored.select(F.col("j").alias("src"), F.col("i").alias("dst"), "sim"))
    if previous is not None:
        edges = edges.unionByName(previous.select("src", "dst", "sim"))
    return topk(edges, k)


def jaccard_pairs(sets: DataFrame, least: float) -> DataFrame:
    """Rows (i, j, sim) of all pairs i < j of sets (id, tokens) with Jaccard similarity >= least > 0.

    Equal sets are compared once. Candidates share a token of their prefix of rarest tokens, which every pair that similar
    does; ids are paired last, from lists of at most MEMBERS equal sets, so that no pair of ids is shuffled.
    """
    keyed = sets.where(F.size("tokens") > 0).select("id", F.array_sort("tokens").alias("tokens"))
    listed = Window.partitionBy("tokens").orderBy("id")
    members = keyed.withColumn("part", F.floor((F.row_number().over(listed) - 1) / MEMBERS)).groupBy("tokens", "part").agg(F.collect_list("id").alias("ids"), F.min("id").alias("first"))
    # a class of equal sets has its least id
    members = saved(members.withColumn("c", F.min("first").over(Window.partitionBy("tokens"))).select("c", "part", "tokens", "ids"))
    classes = members.where("part = 0").select(F.col("c").alias("id"), "tokens")
    alike = _class_pairs(classes, least).unionByName(classes.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("sim")))
    one = members.select(F.col("c").alias("i"), F.col("part").alias("pi"), F.col("ids").alias("a"))
    two = members.select(F.col("c").alias("j"), F.col("part").alias("pj"), F.col("ids").alias("b"))
    # of two parts of one class, the earlier stands first
    met = saved(alike).join(one, "i").join(two, "j").where("i <> j or pi <= pj").select("a", "b", "sim", (F.col("i") == F.col("j")).alias("same"))
    each = met.repartition(F.xxhash64("a"), F.xxhash64("b")).withColumn("x", F.explode("a")).withColumn("y", F.explode("b")).where("not same or x < y")
    return each.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "sim").where("i < j")


def _class_pairs(sets: DataFrame, least: float) -> DataFrame:
    """Rows (i, j, sim), i < j, of distinct sets that similar."""
    tokens = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    rarity = tokens.groupBy("t").agg(F.count("*").alias("df"))
    ranked = tokens.join(rarity, "t").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("df", "t")))
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).select("id", "t", "n")
    a, b = prefix.toDF("i", "t", "ni"), prefix.toDF("j", "t", "nj")
    pairs = a.join(b, "t").where((F.col("i") < F.col("j")) & (F.least("ni", "nj") >= F.lit(least) * F.greatest("ni", "nj"))).select("i", "j").distinct()
    left, right = sets.select(F.col("id").alias("i"), F.col("tokens").alias("a")), sets.select(F.col("id").alias("j"), F.col("tokens").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    sim = both / (F.size("a") + F.size("b") - both)
    return pairs.join(left, "i").join(right, "j").select("i", "j", sim.alias("sim")).where(F.col("sim") >= least)
