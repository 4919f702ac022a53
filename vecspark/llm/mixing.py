"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets share all words by weight; none is above CAP times its source's words, the excess is reshared. Equal-token
blocks are dealt to sources by highest quotients. A source's take is whole passes over it and a rest of blocks; the
blocks' quota of each shard is its share of that rest, rounded along the shards' running sums. In a shard the documents
stand in seeded order, and its quota of blocks is chosen in a seeded rotation.

A shard is a hashed part of a source of about SHARD_ROWS rows, so shards grow in number with the rows and not in size.
The plan is made on keys and sizes alone; texts are joined to it once. The driver holds two numbers for each source, not
their names and never rows of documents.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE_WORD, cut, hex_number, inside, load, row_keys, without_repeats

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
BLOCK = 64
SHARD_ROWS = 1 << 13
SEED = 11
#: Stride of the seeded rotation of a shard's blocks: a prime; a count that it divides falls back to 1.
STRIDE = 1_000_003


def targets(sizes: Sequence[int], weights: Sequence[float], cap: float = CAP) -> list[float]:
    """Shares of sum(sizes) by weight, none above cap times its size; the excess goes to the others by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        free -= set(over)
    return out


def sainte_lague(seats: int, votes: Sequence[float], most: Sequence[int]) -> list[int]:
    """Seats by highest quotients votes / (2 s + 1), none above its most; ties go to the earlier. Starts just below the answer."""
    got = [0] * len(votes)
    seats = min(seats, sum(most))
    total = sum(votes)
    if total > 0:
        got = [min(m, max(0, math.floor(seats * v / total) - 1)) for v, m in zip(votes, most, strict=True)]
    heap = [(-v / (2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes, got, most, strict=True)) if g < m and v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str, source_col: str, text_col: str, *more: Column) -> DataFrame:
    """Rows (id, source, size, seeded, order, crc, *more): what the plan needs of the documents."""
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    crc = F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), hex_number(digest, 1, 8).alias("seeded"), hex_number(digest, 9, 15).alias("order"), crc.alias("crc"), *more)


def quotas(rows: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """(source, n_shards, source_size, target, passes, rest): how often each source is taken, and what share of it once more."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per = cut(per.withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    sizes = [r["source_size"] for r in per.select("no", "source_size").orderBy("no").collect()]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))])
    dealt = sainte_lague(math.floor(sum(sizes) / BLOCK + 0.5), goal, [math.floor(CAP * s / BLOCK) + 1 for s in sizes])
    out = []
    for no, (size, target, q) in enumerate(zip(sizes, goal, dealt, strict=True), 1):
        # at the cap: whole passes, not a block less
        take = CAP * size if abs(target - CAP * size) < BLOCK else min(q * BLOCK, CAP * size)
        passes, rest = divmod(take, size) if size else (0, 0)
        out.append((no, target, passes, rest / size if size else 0.0))
    side = rows.sparkSession.createDataFrame(out, "no int, target double, passes long, rest double")
    n_shards = F.ceil(F.col("n") / SHARD_ROWS).cast("long").alias("n_shards")
    return per.join(side, "no").select("source", n_shards, "source_size", "target", "passes", "rest")


def _on_source(left: DataFrame, right: DataFrame, n: int, *on: str) -> DataFrame:
    """Joins by source (null is one too) and more columns; right is broadcast if it has few rows."""
    side = right.withColumnsRenamed({c: f"_{c}" for c in ("source", *on)})
    how = F.col("source").eqNullSafe(F.col("_source"))
    for c in on:
        how = how & (F.col(c) == F.col(f"_{c}"))
    return left.join(F.broadcast(side) if n <= BROADCAST_ROWS else side, how).drop("_source", *(f"_{c}" for c in on))


def plan(rows: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Adds source_size, target, passes and spans (word ranges of the further take) to checkpointed keys and sizes."""
    q = cut(quotas(rows, weights))
    placed = _on_source(rows, q, q.count()).withColumn("shard", F.col("seeded") % F.col("n_shards"))
    words = placed.groupBy("source", "shard", "rest").agg(F.sum("size").alias("words"))
    blocks = F.when(F.col("words") > 0, F.greatest(F.floor(F.col("words") / BLOCK + 0.5), F.lit(1))).otherwise(0)
    upto = Window.partitionBy("source").orderBy("shard")  # a row for each shard of a source
    running = lambda n: F.floor(n * F.col("rest") + 0.5)
    shards = words.withColumn("blocks", blocks).withColumn("sum", F.sum("blocks").over(upto))
    shards = cut(shards.select("source", "shard", "words", "blocks", (running(F.col("sum")) - running(F.col("sum") - F.col("blocks"))).alias("quota")))
    here = Window.partitionBy("source", "shard").orderBy("order", "id", "crc").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("from", F.coalesce(F.sum("size").over(here), F.lit(0)))
    at = _on_source(at, shards, shards.count(), "shard")
    n, lo = F.col("blocks"), F.col("from")
    hi = lo + F.col("size")
    # block b holds the shard's words from floor(b * words / blocks) on
    edge = lambda b: F.floor(b * F.col("words") / n)
    numbers = F.sequence(F.greatest(F.floor(lo * n / F.col("words")) - 1, F.lit(0)), F.least(F.floor(hi * n / F.col("words")) + 1, n))
    step = F.when(n % STRIDE == 0, F.lit(1)).otherwise(STRIDE)
    taken = F.filter(numbers, lambda b: (b < n) & ((b * step + F.col("shard") * 7919) % n < F.col("quota")))
    spans = F.transform(taken, lambda b: F.struct((F.greatest(edge(b), lo) - lo).alias("lo"), (F.least(edge(b + 1), hi) - lo).alias("hi")))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    return at.withColumn("spans", F.when((F.col("size") > 0) & (F.col("quota") > 0), F.filter(spans, lambda s: s["lo"] < s["hi"])).otherwise(none))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, size, source_size, target, taken.

    A null source is the last source; null and wordless texts have size 0 and taken 0; a source without words has
    target 0. Rows of the same id are mixed each for itself, in the order of their texts' checksums. Further columns
    are ignored, whatever their names; an empty table gives an empty one.
    """
    df = plan(cut(sized(docs, id_col, source_col, text_col)), weights)
    taken = F.col("size") * F.col("passes") + F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    return df.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents come once for each whole take, and once more with the words of their taken blocks.

    Exact repeats of a row are planned each for itself; their common text is joined to all of their plans.
    """
    names = docs.columns
    inner, (i, s, t) = inside(docs, "doc_id", "source", "text")
    keyed = row_keys(inner)
    rows = cut(sized(keyed, i, s, t, F.col("k1"), F.col("k2")))
    how = plan(rows).where("passes > 0 or size(spans) > 0").select("k1", "k2", "passes", "spans")
    out = without_repeats(keyed, rows).join(how.hint("shuffle_hash"), ["k1", "k2"])
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    part = F.when(F.size("spans") > 0, F.array(F.col("spans"))).otherwise(F.array().cast("array<array<struct<lo:bigint,hi:bigint>>>"))
    each = out.withColumn("take", F.explode(F.concat(F.array_repeat(none, F.col("passes").cast("int")), part)))
    words = F.when(F.size("take") > 0, F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)))
    each = each.withColumn("words", words)
    # words is used twice, so the optimizer does not put its expression into the lambda
    cutout = F.array_join(F.flatten(F.transform("take", lambda x: F.slice(F.col("words"), (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int")))), "")
    each = each.withColumn(t, F.when(F.size("words") > 0, cutout).otherwise(F.col(t)))
    counted = [F.length(t).cast("long").alias(c) if n == "n_chars" else F.col(c) for n, c in zip(names, inner.columns, strict=True)]
    return each.select(*counted).toDF(*names)
