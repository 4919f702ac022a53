"""Best-fit packing by a linear grouping scheme.

Documents become token ids plus an end id; those longer than a sequence are cut into pieces, the first of which may be
shorter. What the packing needs of the corpus is the histogram of piece lengths (at most LENGTH numbers). On it, large
lengths are sorted, grouped into groups of equal cardinality and rounded up to their group's largest; the few sizes are
packed by configurations that fill a sequence best, each used as often as the counts allow. Then the actual lengths take
the places, and small lengths go by best fit, longest first, into what is left, with large ones for which no configuration
leaves little enough. The scheme is optimised over SCHEMES, the number of groups (up to one for each length) and what a
configuration may leave; the one of fewest sequences is taken. With nothing left to configurations it is best fit of
decreasing lengths, so the result is never worse than that. The result is a table of runs (length, first number, count,
sequence, offset), bounded by the lengths and groups and not by the documents; a document's number among those of its
length gives its place.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, load, small_or_joined

LENGTH = 1024
END_ID = 2
SMALL = 128
#: Groups of large lengths (0: one for each length) and tokens that a configuration may leave (-1: no configurations).
SCHEMES = ((200, LENGTH), (0, LENGTH), (0, 32), (0, 8), (0, -1))
PART_ROWS = 1 << 16
VOCABULARY = "byte_bpe_50k"

_codecs: dict[str, tuple] = {}


def encoder(vocabulary: str = VOCABULARY):
    """A function from text in UTF-8 to ids, as the vocabulary's tokenizers file gives them.

    The same vocabulary as ranks is several times faster and gives the same ids for text of code points below U+3000
    without the special token's string (the tests compare both); other texts go through the tokenizers file.
    """
    if vocabulary not in _codecs:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        full.no_padding()
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        quick = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _codecs[vocabulary] = full, quick
    full, quick = _codecs[vocabulary]
    rare = re.compile(rb"[\xe3-\xff]|<\|endoftext\|>")

    def ids(body: bytes) -> list[int]:
        text = body.decode("utf-8", "replace")
        return full.encode(text, add_special_tokens=False).ids if rare.search(body) else quick.encode_ordinary(text)

    return ids


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece of each input row: id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(vocabulary)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for r, body in enumerate(b.column(1)):
                got = np.array([*ids(body.as_py()), END_ID], "<u4")
                cuts = [0, *range((len(got) - 1) % LENGTH + 1, len(got) + 1, LENGTH)]
                for p, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(r)
                    piece.append(p)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(got[lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "piece", "start", "length", "ids_crc32"])

    given = docs.select(id_col, F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("_body"))
    return given.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class _Stock:
    """Numbered items of some lengths, taken from the front: segments [length, first number, count]."""

    def __init__(self) -> None:
        self.segments: list[list[int]] = []
        self.count = 0

    def put(self, length: int, first: int, count: int) -> None:
        self.segments.append([length, first, count])
        self.count += count

    def take(self, n: int) -> list[tuple[int, int, int]]:
        out = []
        self.count -= n
        while n:
            seg = self.segments[0]
            k = min(n, seg[2])
            out.append((seg[0], seg[1], k))
            seg[1] += k
            seg[2] -= k
            n -= k
            if not seg[2]:
                self.segments.pop(0)
        return out


def _fill(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """How many of each size (descending) fill room best; of equal fills, the one with larger sizes."""
    came = np.full(room + 1, -1, np.int64)  # the size index through which a fill was first reached
    came[0] = len(sizes)
    for i, (s, c) in enumerate(zip(sizes, counts, strict=True)):
        if s > room or not c:
            continue
        front = np.nonzero(came >= 0)[0]
        for _ in range(min(c, room // s)):
            front = front[front + s <= room] + s
            front = front[came[front] < 0]
            if not len(front):
                break
            came[front] = i
        if came[room] >= 0:
            break
    at = int(np.nonzero(came >= 0)[0][-1])
    out = [0] * len(sizes)
    while at:
        i = int(came[at])
        out[i] += 1
        at -= sizes[i]
    return out


Runs = list[tuple[int, int, int, int, int, int]]


def pack(histogram: dict[int, int]) -> tuple[Runs, int]:
    """Runs (length, first number, bins, each, first bin, offset) and the number of bins, by the best of SCHEMES.

    Numbers first .. first + bins * each - 1 of a length stand in bins first bin .., each of them in a bin, from offset on.
    """
    return min((packed(histogram, groups, slack) for groups, slack in SCHEMES), key=lambda found: found[1])


def packed(histogram: dict[int, int], groups: int, slack: int) -> tuple[Runs, int]:
    """The same by one scheme."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first bin, bins)
    if histogram.get(LENGTH):
        runs.append((LENGTH, 0, histogram[LENGTH], 1, 0, 0))
        bins = histogram[LENGTH]
    large = sorted(n for n, c in histogram.items() if SMALL < n < LENGTH and c)
    per = max(1, -(-sum(histogram[n] for n in large) // groups)) if groups else 0
    stocks: dict[int, _Stock] = {}
    group, held = [], 0
    done = {n: 0 for n in large}

    def close() -> None:
        stock = stocks.setdefault(group[-1][0], _Stock())
        for n, first, c in group:
            stock.put(n, first, c)

    for n in large:
        if not groups:
            stocks[n] = _Stock()
            stocks[n].put(n, 0, histogram[n])
            continue
        while done[n] < histogram[n]:
            c = min(per - held, histogram[n] - done[n])
            group.append((n, done[n], c))
            done[n] += c
            held += c
            if held == per:
                close()
                group, held = [], 0
    if group:
        close()
    sizes = sorted(stocks, reverse=True)
    rest = [[n, 0, histogram[n]] for n in range(1, min(SMALL, LENGTH - 1) + 1) if histogram.get(n)]
    while sizes:
        if slack < 0:
            rest += stocks[sizes.pop(0)].segments
            continue
        counts = [stocks[s].count for s in sizes]
        counts[0] -= 1
        used = _fill(sizes, counts, LENGTH - sizes[0])
        counts[0] += 1
        used[0] += 1
        if LENGTH - sum(u * x for u, x in zip(used, sizes, strict=True)) > slack:
            rest += stocks[sizes.pop(0)].segments
            continue
        times = min(c // u for c, u in zip(counts, used, strict=True) if u)
        lanes = [stocks[s].take(times) for s, u in zip(sizes, used, strict=True) for _ in range(u)]
        where = [0] * len(lanes)
        gone = [0] * len(lanes)
        left = times
        while left:
            k = min(lane[w][2] - g for lane, w, g in zip(lanes, where, gone, strict=True))
            offset = 0
            for j, lane in enumerate(lanes):
                n, first, c = lane[where[j]]
                runs.append((n, first + gone[j], k, 1, bins, offset))
                offset += n
                gone[j] += k
                if gone[j] == c:
                    where[j] += 1
                    gone[j] = 0
            if offset < LENGTH:
                gaps.setdefault(LENGTH - offset, []).append((bins, k))
            bins += k
            left -= k
        sizes = [s for s in sizes if stocks[s].count]
    for n, first, c in sorted(rest, reverse=True):
        while c:
            gap = next((g for g in range(n, LENGTH + 1) if gaps.get(g)), None)
            if gap is None:
                need = -(-c // (LENGTH // n))
                gaps[LENGTH] = [(bins, need)]
                bins += need
                continue
            at, m = gaps[gap].pop()
            each = min(gap // n, c)
            k = min(m, c // each)
            runs.append((n, first, k, each, at, LENGTH - gap))
            if k < m:
                gaps[gap].append((at + k, m - k))
            if gap - each * n:
                gaps.setdefault(gap - each * n, []).append((at, k))
            first += k * each
            c -= k * each
    return runs, bins


def place(cut_pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to checkpointed pieces. Those of a length are numbered in parts of about PART_ROWS rows."""
    names = cut_pieces.columns
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most LENGTH rows
    runs, _ = pack(histogram)
    parts = F.element_at(F.lit([-(-histogram.get(n, 0) // PART_ROWS) or 1 for n in range(1, LENGTH + 1)]), F.col("length").cast("int"))
    spread = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "piece", "ids_crc32"), parts).cast("int")
    dealt = cut_pieces.withColumn("_part", spread)
    counts = cut(dealt.groupBy("length", "_part").count())  # a row for each PART_ROWS pieces, and one for each length
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    here = Window.partitionBy("length", "_part").orderBy(id_col, "piece", "ids_crc32")
    numbered = small_or_joined(dealt.withColumn("_n", F.row_number().over(here) - 1), first, ["length", "_part"], "inner")
    numbered = numbered.select(*names, (F.col("_n") + F.col("_first")).alias("_no"))
    by: dict[int, np.ndarray] = {}
    for n in {r[0] for r in runs}:
        by[n] = np.array(sorted(r[1:] for r in runs if r[0] == n), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, no = b.column(names.index("length")).to_numpy(), b.column(len(names)).to_numpy()
            seq, offset = np.zeros(len(no), np.int64), np.zeros(len(no), np.int64)
            for n in np.unique(length):
                rows = np.nonzero(length == n)[0]
                table = by[int(n)]
                r = table[np.searchsorted(table[:, 0], no[rows], "right") - 1]
                rank = no[rows] - r[:, 0]
                seq[rows] = r[:, 3] + rank // r[:, 2]
                offset[rows] = r[:, 4] + rank % r[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema.fields)
    return numbered.mapInArrow(run, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece, the end id alone. Rows of the same id are packed each for itself. Further columns
    are ignored, whatever their names; an empty table gives an empty one.
    """
    return place(cut(pieces(docs, id_col, text_col, vocabulary)), id_col)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents and their places."""
    return pack_documents(docs)
