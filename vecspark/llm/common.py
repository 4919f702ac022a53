"""Helpers shared by the training-data operators."""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: A side is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 50_000
#: A key with more than one in HOT_KEYS of all rows is hot; there are fewer than HOT_KEYS of them, whatever the input.
HOT_KEYS = 1 << 14


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def inside(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """The table under names in0, in1 .. that clash with none of the operators' own, and the wanted columns' new names.

    A name is looked for as it is written, then in any case. Callers give the old names back with toDF.
    """
    names = docs.columns
    low = [n.lower() for n in names]
    at = [names.index(w) if w in names else low.index(w.lower()) for w in wanted]
    return docs.toDF(*(f"in{i}" for i in range(len(names)))), [f"in{i}" for i in at]


def hex_number(digest: Column, at: int, digits: int) -> Column:
    """The number that some of a digest's hex digits give, as a bigint (at most 15 digits, from 1)."""
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("long")


def row_keys(inner: DataFrame) -> DataFrame:
    """Adds k1 and k2, two hashes of all columns, as the key of a row. Exact repeats of a row have the same."""
    return inner.select("*", F.xxhash64(*inner.columns).alias("k1"), F.xxhash64(F.lit(1), *inner.columns).alias("k2"))


def without_repeats(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """One row for each key (k1, k2); keys: the same rows' keys, checkpointed. Only rows with repeats are aggregated."""
    again = cut(keys.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2"))
    if again.isEmpty():
        return keyed
    once = small_or_joined(keyed, again, ["k1", "k2"], "left_anti")
    return once.unionByName(small_or_joined(keyed, again, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    It is the session's spark.checkpoint.dir. Only where that is unset on one machine a temporary folder is made.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("a cluster needs a shared folder: set spark.checkpoint.dir")
            folder = tempfile.mkdtemp(prefix="vecspark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_or_joined(big: DataFrame, side: DataFrame, on: list[str], how: str) -> DataFrame:
    """Joins a checkpointed side; it is broadcast only if it was counted to be small."""
    if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return big.join(side, on, how)


def join_counted(big: DataFrame, side: DataFrame, on: list[str], rows: int) -> DataFrame:
    """Inner join with side, which is unique by on; its column n, which goes, counts big's rows of each key. rows: all of big's.

    Hot keys are broadcast, being fewer than HOT_KEYS, and their rows stay where they are. Rows of the other keys are
    dealt by key, and no key has more than one in HOT_KEYS of them. Both sides must be checkpointed: they are read twice.
    """
    is_hot = F.col("n") > rows // HOT_KEYS
    hot = F.broadcast(side.where(is_hot).drop("n"))
    rest = big.join(F.broadcast(side.where(is_hot).select(*on)), on, "left_anti").join(side.where(~is_hot).drop("n"), on)
    return big.join(hot, on).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), both bigint: one row (node, root) for each node that has an edge.

    root is some node of the component, the same for all its nodes. Each round sends every node to the
    neighbour of least random priority and contracts the edges, so paths and stars both shrink by a constant
    factor a round. Rows are only aggregated by node (with partial aggregation) and joined on unique keys, so a
    hub's edges never meet in one task.
    """
    maps = []
    left = cut(edges.where("a <> b").select("a", "b").distinct())
    for rnd in itertools.count():
        if left.isEmpty():
            break
        prio = lambda c: F.xxhash64(F.col(c), F.lit(rnd))
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(prio("b").alias("p"), F.col("b").alias("to"))).alias("m"))
        here = F.struct(prio("a").alias("p"), F.col("a").alias("to"))
        step = cut(best.select(F.col("a").alias("node"), F.least(F.col("m"), here)["to"].alias("root")))
        maps.append(step)
        one, two = step.toDF("a", "ra"), step.toDF("b", "rb")
        left = cut(left.join(one, "a").join(two, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if not maps:
        return left.toDF("node", "root")
    out = maps[0]
    for step in maps[1:]:
        nxt = step.toDF("root", "_next")
        out = out.join(nxt, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    return out
