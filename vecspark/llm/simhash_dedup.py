"""SimHash near-dedup with covering locality-sensitive hashing.

Bit masks for radius 2 come from a covering code: bit i gets a nonzero vector m(i) of three bits, and mask v keeps the
bits whose m(i) has odd overlap with v. Two differing bits are always both orthogonal to some v, so every pair within
the radius agrees on one of the seven masks. The same code again on the bits that a mask leaves out gives 49 tables of
keys of about 52 bits, so that a table's bucket holds at most 2 ** (64 - kept bits) distinct fingerprints, whatever the
input. Copies are collapsed to distinct fingerprints first; buckets give a spanning forest of their links, not all
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, inside, join_counted, load, row_keys, small_or_joined, without_repeats

SEED = 42
RADIUS = 2
SHINGLE = 3
CHUNK = 1 << 15


def fingerprint(body: bytes) -> int:
    """Fingerprint of a text in UTF-8 (unsigned); a text without words has 0. Memory beyond the text's words is bounded by CHUNK."""
    words = body.lower().split()  # bytes: A-Z only, and the six ASCII spaces only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    lo, hi = starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(lo), CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(lo[at : at + CHUNK], hi[at : at + CHUNK], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.nonzero(2 * counts > len(lo))[0].tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, fp) for each input row; fp is the fingerprint as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py()) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    given = docs.select(id_col, F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("_body"))
    return given.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def _covering(bits: list[int]) -> list[int]:
    """Seven masks over the given bits: any two of the bits are both left out by one of them."""
    vectors = range(1, 1 << (RADIUS + 1))
    code = {bit: 1 + i % len(vectors) for i, bit in enumerate(bits)}
    return [sum(1 << bit for bit, m in code.items() if (m & v).bit_count() % 2) for v in vectors]


def masks() -> list[int]:
    """The 49 masks: covering masks, each joined with covering masks of the bits that it leaves out."""
    out = []
    for one in _covering(list(range(64))):
        rest = [b for b in range(64) if not one >> b & 1]
        out += [one | two for two in _covering(rest)]
    return out


def _forest(fps: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each bucket (rows of a bucket stand together), as edges from each fingerprint to its part's first one."""
    n = len(fps)
    label = np.arange(n)
    size = np.diff(np.concatenate((np.nonzero(np.concatenate(([True], group[1:] != group[:-1])))[0], [n])))
    end = np.repeat(np.cumsum(size), size)
    a, b, lag = [], [], 1
    live = np.nonzero(np.arange(n) + lag < end)[0]
    while len(live):
        near = live[np.bitwise_count(fps[live] ^ fps[live + lag]) <= RADIUS]
        a.append(near)
        b.append(near + lag)
        lag += 1
        live = live[live + lag < end[live]]
    if not a:
        return fps[:0], fps[:0]
    a, b = np.concatenate(a), np.concatenate(b)
    while True:  # the least row reaches all of its part
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(label != np.arange(n))[0]
    return fps[moved], fps[label[moved]]


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints (column fp) within the radius."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks()]
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("t", "key"))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(parts, "t", "key").sortWithinPartitions("t", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.empty(0, np.int64)] * 3

        def out(fp: np.ndarray, t: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            change = np.concatenate(([True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])))
            a, b = _forest(fp, np.cumsum(change))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            cols = [np.concatenate((r, batch.column(i).to_numpy().astype(np.int64))) for i, r in enumerate(rest)]
            if not len(cols[0]):
                continue
            last = (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])  # the last bucket may go on in the next batch
            stop = len(last) - int(last.sum())
            rest = [c[stop:] for c in cols]
            if stop:
                yield out(*(c[:stop] for c in cols))
        if len(rest[0]):
            yield out(*rest)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def groups(fps: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Checkpointed (id, fp) with component_id, the smallest id of the component; a fingerprint of many copies loads no task."""
    per = cut(fps.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("copies")))
    roots = components(links(per))
    rooted = cut(per.join(roots, per.fp == roots.node, "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    named = cut(join_counted(rooted, least, ["root"], rooted.count()).select("fp", "component_id", F.col("copies").alias("n")))
    return join_counted(fps, named, ["fp"], fps.count())


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and are linked with each other. Rows of the same id are nodes of their
    own. Null ids take part; a component of null ids alone has a null component_id.
    """
    out = groups(cut(fingerprints(docs, id_col, text_col)), id_col)
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(load(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group one row stays, the one of the smallest doc_id.

    A row is its doc_id, its text and its other columns. Null ids come last, and equal ids are told apart by hashes; so
    rows of one id in different groups do not touch each other, nor do rows without an id. Exact repeats of the row that
    stays are dropped. The groups are decided on keys; texts are joined once, or not moved at all if few rows go.
    """
    names = docs.columns
    inner, (i, t) = inside(docs, "doc_id", "text")
    keyed = row_keys(inner)
    row = F.struct(F.col(i).isNull().alias("none"), F.col(i).alias("id"), "k1", "k2")
    found = cut(groups(cut(fingerprints(keyed.select(row.alias("row"), t), "row", t)), "row"))
    gone = cut(found.where("row <> component_id").select("row.k1", "row.k2").distinct())
    kept = without_repeats(keyed, found.select("row.k1", "row.k2"))
    return small_or_joined(kept, gone, ["k1", "k2"], "left_anti").select(*inner.columns).toDF(*names)
