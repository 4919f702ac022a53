"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Two numbers of the key's digest and two of the shard give a uniform number u; the shard of highest -weight / ln(u) wins.
With one more shard a record moves only if the new shard wins, so about 1 / (n + 1) of the rows move, all into the new
one. Slots are numbered without gaps in two levels: rows are dealt into parts of about PART_ROWS rows of each shard, and
the parts' counts give each part's first slot. No task ever holds a whole shard.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, hex_number, load

PART_ROWS = 1 << 16
SEED = 7
PRIME = 2147483647


def constants(n: int) -> list[tuple[int, int]]:
    """Two numbers for each shard; those of a shard do not depend on how many there are."""
    rng = random.Random(SEED)
    return [(rng.randrange(PRIME), rng.randrange(PRIME)) for _ in range(n)]


def _best(a: Column, b: Column, weights: Sequence[float], shards: Sequence[int]) -> Column:
    """(score, -shard) of the winner among some shards; ties go to the smaller number. a, b: numbers of the key."""
    known = constants(max(shards) + 1)
    table = F.array(*(F.struct(F.lit(s).alias("no"), F.lit(known[s][0]).cast("long").alias("x"), F.lit(known[s][1]).cast("long").alias("y"), F.lit(float(weights[s])).alias("w")) for s in shards))

    def scored(s: Column) -> Column:
        one = (a + s["x"]) % PRIME
        u = (one * one % PRIME) * ((b + s["y"]) % PRIME) % PRIME
        return F.struct((-s["w"] / F.log((u + 0.5) / float(PRIME))).alias("score"), (-s["no"]).alias("no"))

    return F.array_max(F.transform(table, scored))


def shard(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, size, text_crc32, law, shard, slot, grown_shard.

    Null texts count as empty (size 16, crc 0). A null id is a key of its own. Rows with the same id land in the same
    shard in slots of their own. grown: the weights with more shards behind the same ones, or null for no grown_shard.
    Further columns are ignored, whatever their names; an empty table gives an empty one.
    """
    n = len(weights)
    if grown and list(grown[:n]) != list(weights):
        raise ValueError("grown must begin with weights")
    parts = max(1, -(-docs.count() // (n * PART_ROWS)))
    body = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    numbers = [hex_number(digest, 1, 7).alias("a"), hex_number(digest, 8, 7).alias("b"), (hex_number(digest, 15, 7) % parts).cast("int").alias("part")]

    size = (F.octet_length(body) + 16).cast("long")
    base = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), *numbers)
    base = base.withColumn("best", _best(F.col("a"), F.col("b"), weights, range(n)))
    later = F.greatest(F.col("best"), _best(F.col("a"), F.col("b"), grown, range(n, len(grown)))) if grown and len(grown) > n else F.col("best")
    base = base.select("id", "size", "text_crc32", (-F.col("best.no")).cast("int").alias("shard"), "part", ((-later["no"]).cast("int") if grown else F.lit(None).cast("int")).alias("grown_shard"))
    base = cut(base)  # a few numbers a row, so that shards are computed once
    counts = base.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))  # shards * parts rows
    here = Window.partitionBy("shard", "part").orderBy("id", "text_crc32", "size")
    out = base.withColumn("place", F.row_number().over(here)).join(F.broadcast(first) if n * parts <= BROADCAST_ROWS else first, ["shard", "part"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place") - 1).alias("slot"), "grown_shard")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(load(spark, sf_dir, "documents"), [1.0] * 40, [1.0] * 41)
