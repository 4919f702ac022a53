"""Embedding near-dedup by lattice hashing.

Each table projects unit vectors to one or more times eight dimensions with seeded Gaussians and decodes each block of
eight to the nearest point of the E8 lattice; the points together are the vector's own cell. It also looks into the
PROBES neighbouring cells that its residuals point to most. Candidates of a cell are verified by cosine in double
precision. Vectors of different lengths never meet.

The number of blocks grows with the logarithm of the rows, so that a cell of unrelated vectors stays small; the number of
tables follows from it: as many as the recall RECALL at cosine exactly COSINE needs, by simulated pairs of that length.

Exact copies are collapsed to one vector with its count first. A pair is counted only in the first table (and in one cell
of it) where it meets, so each cell returns counts and a spanning forest of its links, a row for each member at most,
never all pairs.

Cells above HOT members are split into blocks; each pair of blocks is a task of its own, so that no task holds more
than 2 * HOT vectors of a cell.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, load, small_or_joined

#: Scale of the projections by the number of blocks; the last for all further numbers.
SCALES = (0.75, 0.5)
PROBES = 4
COSINE = 0.9
RECALL = 0.96
#: Up to so many rows one block; a block more for each further factor of 2 ** 5.
ONE_BLOCK = 1 << 17
SEED = 13
HOT = 4096
TILE = 1024
#: Members of a cell up to which pairs are taken one by one, many cells at a time.
LITTLE = 32


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum."""
    r = np.rint(x)
    e = x - r
    k = np.abs(e).argmax(axis=1)
    rows = np.arange(len(x))
    r[rows, k] += np.where(r.sum(axis=1) % 2 != 0, np.where(e[rows, k] >= 0, 1.0, -1.0), 0.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: integers of even sum, or those moved by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def blocks_for(n: int) -> int:
    """Blocks of eight dimensions for so many vectors."""
    return 1 + max(0, math.ceil((math.log2(max(n, 1)) - math.log2(ONE_BLOCK)) / 5))


@lru_cache(maxsize=256)
def _projection(dim: int, blocks: int, table: int) -> np.ndarray:
    scale = SCALES[min(blocks, len(SCALES)) - 1]
    return np.random.default_rng([SEED, dim, blocks, table]).normal(size=(dim, 8 * blocks)) * scale


_SHIFTS = _roots()
_MIXER = np.random.default_rng(SEED + 1).integers(1, 1 << 62, 64, dtype=np.int64) | 1


def table_cells(x: np.ndarray, blocks: int, table: int) -> np.ndarray:
    """Cell numbers (rows, 1 + PROBES) of unit vectors in one table; the first is the own cell."""
    n = len(x)
    y = (x @ _projection(x.shape[1], blocks, table)).reshape(n * blocks, 8)
    own = decode(y)
    gain = (y - own) @ _SHIFTS.T
    near = np.argsort(-gain, axis=1, kind="stable")[:, :PROBES]
    gains = np.take_along_axis(gain, near, axis=1).reshape(n, blocks * PROBES)
    with np.errstate(over="ignore"):
        # a cell's number is a sum over its coordinates, so that a probe only adds its shift's part
        weights = np.stack([_MIXER[:8] * _MIXER[8 + b % 48] + b for b in range(blocks)])
        points = np.rint(own * 2).astype(np.int64).reshape(n, blocks, 8)
        home = (points * weights).sum(axis=(1, 2)) + (table + 1) * _MIXER[60] + x.shape[1] * _MIXER[61]
        shift = np.rint(_SHIFTS * 2).astype(np.int64) @ weights.T  # (240, blocks)
        moves = np.take_along_axis(shift.T[None, :, :], near.reshape(n, blocks, PROBES), axis=2).reshape(n, blocks * PROBES)
        best = np.argsort(-gains, axis=1, kind="stable")[:, :PROBES]
        h = np.concatenate((home[:, None], home[:, None] + np.take_along_axis(moves, best, axis=1)), axis=1)
        h ^= h >> 29
        h *= _MIXER[62]
        return h ^ (h >> 32)


@lru_cache(maxsize=256)
def tables_for(dim: int, blocks: int) -> int:
    """Tables after which a pair at cosine exactly COSINE has met with probability RECALL, by simulated pairs."""
    rng = np.random.default_rng([SEED + 2, dim])
    a, r = rng.normal(size=(2, 2000, dim))
    a = _unit(a)
    if dim > 1:
        r = _unit(r - (r * a).sum(axis=1, keepdims=True) * a)
    b = a if dim == 1 else COSINE * a + math.sqrt(1 - COSINE**2) * r
    open_ = np.ones(len(a), bool)
    for t in itertools.count():
        ca, cb = table_cells(a, blocks, t), table_cells(b, blocks, t)
        open_ &= ~_met(ca, cb)
        if open_.mean() <= 1 - RECALL:
            return t + 1


def _met(ca: np.ndarray, cb: np.ndarray) -> np.ndarray:
    """Whether rows of cells meet in a table: one looks into the other's own cell."""
    return (ca == cb[:, :1]).any(axis=1) | (cb == ca[:, :1]).any(axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(v: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _close(x: np.ndarray, start: np.ndarray, end: np.ndarray, allowed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs a < b of the same cell (rows start .. end - 1) that are similar and allowed(a, b)."""
    size = end - start
    little = size <= LITTLE
    live = np.nonzero(little & (np.arange(len(x)) + 1 < end))[0]
    lag = 1
    while len(live):
        for at in range(0, len(live), 1 << 15):
            a = live[at : at + (1 << 15)]
            a = a[allowed(a, a + lag)]
            hit = a[np.einsum("ij,ij->i", x[a], x[a + lag]) >= COSINE]
            if len(hit):
                yield hit, hit + lag
        lag += 1
        live = live[live + lag < end[live]]
    for lo in np.unique(start[~little]):
        hi = end[lo]
        for i in range(lo, hi, TILE):
            for j in range(i, hi, TILE):
                a, b = np.nonzero(x[i : min(i + TILE, hi)] @ x[j : min(j + TILE, hi)].T >= COSINE)
                a, b = a + i, b + j
                keep = (a < b) & allowed(a, b)
                if keep.any():
                    yield a[keep], b[keep]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the rows of each pair, and all that had their labels, one label."""
    while True:
        ra, rb = label[a], label[b]
        differ = ra != rb
        if not differ.any():
            return
        np.minimum.at(label, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
        while (label[label] != label).any():
            label[:] = label[label]


def _cell_links(x: np.ndarray, key: np.ndarray, home: np.ndarray, node: np.ndarray, w: np.ndarray, blk: np.ndarray, blocks: int) -> pa.RecordBatch | None:
    """(node, n, other) of whole cells; key: (cell, t, lo, hi) by row, rows of a cell stand together."""
    n = len(x)
    new = np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0)))
    first = np.nonzero(new)[0]
    which = np.cumsum(new) - 1
    start, end = first[which], np.concatenate((first[1:], [n]))[which]
    table, cross = key[1], key[2] != key[3]
    allowed = lambda a, b: (home[a] | home[b]) & ~(cross[a] & (blk[a] == blk[b]))
    found = list(_close(x, start, end, allowed))
    if not found:
        return None
    a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    # cells of all tables are only computed for rows that have a link
    rows, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    pa_, pb_ = place[: len(a)], place[len(a) :]
    t = table[a]
    small_a = node[a] < node[b]
    ok = np.ones(len(a), bool)
    for no in range(int(t.max()) + 1):
        c = table_cells(x[rows], blocks, no)
        late = t > no  # met in an earlier table
        ok[late] &= ~_met(c[pa_[late]], c[pb_[late]])
        # if one looks into the other's cell, of both ways the smaller node's own cell counts
        now = np.nonzero((t == no) & ~(home[a] & home[b]))[0]
        small, large = np.where(small_a[now], pa_[now], pb_[now]), np.where(small_a[now], pb_[now], pa_[now])
        at_small = np.where(small_a[now], home[a[now]], home[b[now]])
        ok[now] &= at_small | ~(c[large] == c[small][:, :1]).any(axis=1)
    a, b = a[ok], b[ok]
    if not len(a):
        return None
    count, label = np.zeros(n, np.int64), np.arange(n)
    np.add.at(count, a, w[b])
    np.add.at(count, b, w[a])
    _join(label, a, b)
    hit = np.nonzero(count)[0]
    return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(count[hit]), pa.array(node[label[hit]])], names=["node", "n", "other"])


def links(vectors: DataFrame, n: int) -> DataFrame:
    """Rows (node, n, other) for n distinct vectors (node, vec, w): n weighs the links first met in a cell; other is a linked node.

    Components travel as they are stored, 4 or 8 bytes each.
    """
    spark, blocks = vectors.sparkSession, blocks_for(n)
    kind = np.dtype("<f4" if vectors.schema["vec"].dataType.elementType.simpleString() == "float" else "<f8")

    def emit(with_vector: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = np.diff(batch.column(1).offsets.to_numpy())
                for dim in np.unique(sizes).tolist():
                    same = batch.take(pa.array(np.nonzero(sizes == dim)[0]))
                    tables = tables_for(dim, blocks)
                    for at in range(0, same.num_rows, 2048):
                        part = same.slice(at, 2048)
                        raw = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
                        x = _unit(raw.astype(np.float64))
                        held = pa.array([v.tobytes() for v in raw], pa.binary()) if with_vector else None
                        rows = pa.array(np.repeat(np.arange(len(x)), 1 + PROBES))
                        for t in range(tables):
                            cell = pa.array(table_cells(x, blocks, t).reshape(-1))
                            if not with_vector:
                                yield pa.RecordBatch.from_arrays([cell], names=["cell"])
                                continue
                            home = pa.array(np.tile(np.arange(1 + PROBES) == 0, len(x)))
                            yield pa.RecordBatch.from_arrays([cell, pa.array(np.full(len(cell), t, np.int32)), home, part.column(0).take(rows), part.column(2).take(rows), held.take(rows)], names=["cell", "t", "home", "node", "w", "vec"])

        return run

    given = vectors.select("node", "vec", "w")
    sizes = given.mapInArrow(emit(False), "cell long").groupBy("cell").count()
    hot = cut(sizes.where(F.col("count") > HOT).select("cell", F.ceil(F.col("count") / HOT).cast("int").alias("nb")))
    rows = given.mapInArrow(emit(True), "cell long, t int, home boolean, node long, w long, vec binary")
    rows = small_or_joined(rows, hot, ["cell"], "left").withColumn("blk", F.when(F.col("nb").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("nb"))).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.coalesce("nb", F.lit(1)) - 1), lambda o: F.struct(F.least(o, F.col("blk")).alias("lo"), F.greatest(o, F.col("blk")).alias("hi")))
    rows = rows.withColumn("o", F.explode(others)).select("cell", "t", F.col("o.lo").alias("lo"), F.col("o.hi").alias("hi"), "blk", "home", "node", "w", "vec")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "cell", "t", "lo", "hi").sortWithinPartitions("cell", "t", "lo", "hi", "node")

    def whole(part: pa.Table) -> Iterator[pa.RecordBatch]:
        """Links of whole cells; cells of vectors of different lengths have different numbers, but may follow each other."""
        lengths = pa.compute.binary_length(part.column("vec")).to_numpy()
        for size in np.unique(lengths):
            same = part.filter(pa.array(lengths == size)) if (lengths != size).any() else part
            raw = np.frombuffer(b"".join(same.column("vec").to_pylist()), kind).reshape(same.num_rows, -1)
            key = np.array([same.column(k).to_numpy().astype(np.int64) for k in ("cell", "t", "lo", "hi")])
            out = _cell_links(_unit(raw.astype(np.float64)), key, *(same.column(k).to_numpy() for k in ("home", "node", "w", "blk")), blocks)
            if out is not None:
                yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch])
            held = pa.concat_tables([rest, held]).combine_chunks() if rest is not None else held
            if not held.num_rows:
                continue
            keys = np.array([held.column(k).to_numpy().astype(np.int64) for k in ("cell", "t", "lo", "hi")])
            last = np.nonzero((keys != keys[:, -1:]).any(axis=0))[0]  # the last cell may go on in the next batch
            stop = int(last[-1]) + 1 if len(last) else 0
            if stop:
                yield from whole(held.slice(0, stop))
            rest = held.slice(stop)
        if rest is not None:
            yield from whole(rest)

    return dealt.mapInArrow(run, "node long, n long, other long")


def near_dedup(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each input row: id, n_links, component_id, kept.

    Vectors that are null, zero, or hold null or non-finite components have no links and are components of their own;
    so have vectors no links with those of another length. Repeated rows are linked with each other like any copies,
    also if they have the same id. Rows with a null id take part; a component of such rows alone has a null
    component_id, and they are kept. Further columns are ignored; an empty table gives an empty one.
    """
    kind = "float" if table.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    rows = table.select(F.col(id_col).alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    good = F.coalesce(_valid(F.col("vec")), F.lit(False))
    # two hashes of 64 bits stand for a vector
    same = rows.where(good).select("id", "vec", F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(SEED), "vec").alias("k2"))
    # numbers are given once: the checkpoint fixes them
    distinct = cut(same.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("w"), F.min("vec").alias("vec")).withColumn("node", F.monotonically_increasing_id()))
    n = distinct.count()
    found = cut(links(distinct, n))
    counted = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    linked = (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links")
    rooted = cut(distinct.drop("vec").join(counted, "node", "left").join(roots, "node", "left").select("k1", "k2", "id", linked, F.coalesce("root", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.join(least, "root").select("k1", "k2", "n_links", "component_id")
    judged = same.select("id", "k1", "k2").join(named, ["k1", "k2"]).select("id", "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    lone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return judged.unionByName(lone).withColumnRenamed("id", id_col)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(load(spark, sf_dir, "embeddings"))
