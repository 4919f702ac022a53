"""Suffix-array dedup by distributed prefix doubling over sampled positions.

A byte goes if a 50-byte string over it also starts in a document with a smaller id. Positions are sampled by content:
of the GRAM-byte strings in each 50-byte window the one of least hash, so equal windows have their sample at the same
place. The rounds, each of them a shuffle by rank in which ranks that turn out unique to a document are dropped:

1. Samples are ranked by their GRAM-byte string (batches of documents send their distinct ranks as packed blocks).
2. Samples of ranks that several documents have are ranked again with what stands around them: the pairs (rank of the
   string with x bytes to the left, rank of it with y bytes to the right) are sorted at growing offsets x and y up to the
   threshold, and each pair past it gets its least document. Where more than `hot` documents have a rank, its pairs
   are spread by their own hash instead of meeting in the rank's bucket.
3. Documents find their samples again, get the verdicts on them and lose the bytes of all windows that an earlier
   document has.

Batches send each distinct surrounding once, with its least document; where it stands is found again at home. A passage
that stands in all documents is thus one row a batch inside, and at its edges, where surroundings differ, one row a
document and offset, spread over all tasks. Memory follows one batch (documents / BATCHES) and one bucket of ranks.
The documents are shuffled once; the rounds read the same exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

THRESHOLD = 50
GRAM = 25
WINDOW = THRESHOLD - GRAM + 1
SIDE = THRESHOLD - GRAM
CHUNK = 1 << 17
#: Batches of documents for each shuffle partition.
BATCHES = 4
#: Documents that have a rank beyond which its windows are spread over the buckets one by one.
HOT = 1 << 16
LAST = 2**63 - 1

_rng = np.random.default_rng(17)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_SECOND = _rng.integers(1, 1 << 63, (GRAM, 256), dtype=np.uint64)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over a[i : i + width] for each i."""
    n = 1
    while n * 2 <= width:
        a = op(a[:-n], a[n:])
        n *= 2
    return op(a[: len(a) - (width - n)], a[width - n :]) if width > n else a


def _ranks(part: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on."""
    with np.errstate(over="ignore"):
        level, size, mult = _BYTES[part], 1, _MULT
        out, done = None, 0
        while True:
            if GRAM & size:
                piece = level[done:]
                out = piece if out is None else out[: len(piece)] * mult + piece[: len(out)]
                done += size
            if size * 2 > GRAM:
                break
            level = level[:-size] * mult + level[size:]
            size *= 2
            mult = mult * mult + np.uint64(2)
        out = out[: len(part) - GRAM + 1]
        out = (out ^ (out >> np.uint64(32))) * _MULT
        return (out ^ (out >> np.uint64(29))) | np.uint64(1)


def samples(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions of the documents that end at ends, and their ranks. Works through CHUNK positions at a time."""
    at, rank = [], []
    n = len(buf)
    halo = WINDOW - 1
    for lo in range(0, n - THRESHOLD + 1, CHUNK):
        hi = min(lo + CHUNK, n - THRESHOLD + 1)  # windows lo .. hi - 1 with all before them that reach into them
        first = max(0, lo - halo)
        last = min(hi + halo, n - THRESHOLD + 1)
        h = _ranks(buf[first : last + THRESHOLD - 1])
        low = _slide(h, WINDOW, np.minimum)  # of windows first .. last - 1
        # windows that cross a document's end don't count
        crossing = np.searchsorted(ends, np.arange(first, last), "right")
        low = np.where(np.arange(first, last) + THRESHOLD <= ends[np.minimum(crossing, len(ends) - 1)], low, np.uint64(0))
        # a gram is sampled if it is the least of a window that holds it
        padded = np.concatenate((np.zeros(halo, np.uint64), low, np.zeros(halo, np.uint64)))
        best = _slide(padded, WINDOW, np.maximum)[: len(h)]
        q = np.nonzero(best == h)[0]
        where = q + first
        keep = (where >= lo) & (where < hi) if hi < n - THRESHOLD + 1 else where >= lo
        at.append(where[keep])
        rank.append(h[q[keep]])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(at), np.concatenate(rank)


def _documents(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Bodies in an order that the rows alone decide, their keys, the joined bytes and each body's end."""
    rows = sorted(zip(table.column("key").to_pylist(), table.column("body").to_pylist(), strict=True))
    bodies = [b for _, b in rows]
    ends = np.cumsum([len(b) for b in bodies]) if bodies else np.empty(0, np.int64)
    return bodies, np.array([k for k, _ in rows], np.int64), np.frombuffer(b"".join(bodies), np.uint8), ends


def _first_round(table: pa.Table, buckets: int) -> pa.Table:
    """(bucket, batch, ranks, documents): the batch's distinct ranks, and how many of its documents have them."""
    batch = table.column("batch")[0].as_py()
    _, keys, buf, ends = _documents(table)
    at, rank = samples(buf, ends)
    rank, count = _documents_of(rank, keys[np.searchsorted(ends, at, "right")])
    out = {"bucket": [], "batch": [], "ranks": [], "documents": []}
    for b, rows in _split(_bucket(rank, buckets)):
        out["bucket"].append(b)
        out["batch"].append(batch)
        out["ranks"].append(rank[rows].tobytes())
        out["documents"].append(np.minimum(count[rows], 65535).astype("<u2").tobytes())
    return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("ranks", pa.binary()), ("documents", pa.binary())]))


def _documents_of(rank: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ranks, ascending, and the number of distinct documents of each."""
    order = np.lexsort((doc, rank))
    rank, doc = rank[order], doc[order]
    new_rank = np.concatenate((np.ones(min(len(rank), 1), bool), rank[1:] != rank[:-1]))
    new_doc = new_rank.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    start = np.nonzero(new_rank)[0]
    return rank[start], np.add.reduceat(new_doc.astype(np.int64), start) if len(start) else np.empty(0, np.int64)


def _bucket(rank: np.ndarray, buckets: int) -> np.ndarray:
    return ((rank >> np.uint64(1)) % np.uint64(buckets)).astype(np.int32)


def _split(bucket: np.ndarray):
    """Each number and its rows."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.nonzero(np.concatenate(([True], b[1:] != b[:-1])))[0]
    for lo, hi in zip(cuts, [*cuts[1:], len(b)], strict=True):
        yield int(b[lo]), order[lo:hi]


def _repeated(table: pa.Table, hot: int) -> pa.Table:
    """(batch, ranks, hot): what of each batch's ranks other documents have too, and whether over `hot` documents do."""
    ranks = [np.frombuffer(x, np.uint64) for x in table.column("ranks").to_pylist()]
    owner = np.repeat(np.arange(len(ranks), dtype=np.int32), [len(r) for r in ranks])
    rank = np.concatenate(ranks)
    count = np.concatenate([np.frombuffer(x, "<u2") for x in table.column("documents").to_pylist()]).astype(np.int64)
    order = np.argsort(rank, kind="stable")
    rank, count, owner = rank[order], count[order], owner[order]
    new = np.concatenate(([True], rank[1:] != rank[:-1]))
    total = np.add.reduceat(count, np.nonzero(new)[0])[np.cumsum(new) - 1]
    hit = np.nonzero(total > 1)[0]
    batches = table.column("batch").to_pylist()
    out = {"batch": [], "ranks": [], "hot": []}
    for o, rows in _split(owner[hit]):
        out["batch"].append(batches[o])
        out["ranks"].append(rank[hit[rows]].tobytes())
        out["hot"].append((total[hit[rows]] > hot).tobytes())
    return pa.table(out, schema=pa.schema([("batch", pa.int32()), ("ranks", pa.binary()), ("hot", pa.binary())]))


def _packed(a: np.ndarray) -> bytes:
    """A structured array column by column, compressed."""
    cols = [np.ascontiguousarray(a[n]).view(np.uint8).reshape(len(a), -1) for n in a.dtype.names]
    # of numbers, bytes of the same weight stand together
    return zstandard.ZstdCompressor(level=1).compress(b"".join((c if a.dtype[n].subdtype else np.ascontiguousarray(c.T)).tobytes() for n, c in zip(a.dtype.names, cols, strict=True)))


def _unpacked(raw: bytes, kind: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n, lo = len(raw) // kind.itemsize, 0
    out = np.empty(n, kind)
    for name in kind.names:
        size = kind[name].itemsize
        part = np.frombuffer(raw, np.uint8, n * size, lo)
        lo += n * size
        if kind[name].subdtype:
            out[name] = part.reshape(n, size)
        else:
            out[name] = np.ascontiguousarray(part.reshape(size, n).T).view(kind[name])[:, 0]
    return out


def _sides(buf: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """SIDE bytes to the left (nearest first) and right of each sample, 0 beyond its document, and how many there are."""
    n_left = np.minimum(at - begin, SIDE).astype(np.uint8)
    n_right = np.minimum(end - at - GRAM, SIDE).astype(np.uint8)
    left, right = np.zeros((len(at), SIDE), np.uint8), np.zeros((len(at), SIDE), np.uint8)
    for i in range(SIDE):
        rows = np.nonzero(n_left > i)[0]
        left[rows, i] = buf[at[rows] - 1 - i]
        rows = np.nonzero(n_right > i)[0]
        right[rows, i] = buf[at[rows] + GRAM + i]
    return left, right, n_left, n_right


CONTEXT = np.dtype([("rank", "<u8"), ("second", "<u4"), ("sizes", "u1", 2), ("left", "u1", SIDE), ("right", "u1", SIDE)])
FIRST = np.dtype([("key", "<i8")])
#: A window around a hot sample, the least of the batch's documents that have it, and whether several do.
HELD = np.dtype([("rank", "<u8"), ("window", "<u8"), ("key", "<i8"), ("several", "u1")])
#: Verdicts that return: bits of the offsets for a context, and the least document of a hot window.
SAID = np.dtype([("rank", "<u4"), ("context", "<u8"), ("offsets", "<u4")])
SEEN = np.dtype([("rank", "<u4"), ("window", "<u8"), ("key", "<i8")])


def _contexts(buf: np.ndarray, ends: np.ndarray, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    row = np.searchsorted(ends, at, "right")
    ctx = np.zeros(len(at), CONTEXT)
    ctx["rank"] = rank
    with np.errstate(over="ignore"):
        second = np.zeros(len(at), np.uint64)
        for i in range(GRAM):
            second = second * _MULT + _SECOND[i][buf[at + i]]
        ctx["second"] = second >> np.uint64(32)
    begin = np.concatenate(([0], ends[:-1])).astype(np.int64)[row]
    ctx["left"], ctx["right"], ctx["sizes"][:, 0], ctx["sizes"][:, 1] = _sides(buf, at, begin, ends[row])
    return ctx


def _distinct(ctx: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct contexts, each row's number among them, and each one's least key."""
    raw, which = np.unique(ctx.view(f"V{CONTEXT.itemsize}"), return_inverse=True)
    least = np.full(len(raw), LAST, np.int64)
    np.minimum.at(least, which, keys)
    return np.frombuffer(raw.tobytes(), CONTEXT), which, least


def _mix(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ value.astype(np.uint64)) * _MULT
        return h ^ (h >> np.uint64(29))


def _hash(ctx: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(ctx).view("<u8").reshape(len(ctx), CONTEXT.itemsize // 8)
    h = np.full(len(ctx), 1, np.uint64)
    for i in range(words.shape[1]):
        h = _mix(h, words[:, i])
    return _mix(h, h >> np.uint64(32))


def _windows(ctx: np.ndarray):
    """(offset x, contexts that have x bytes to the left and SIDE - x to the right, hash of their window)."""
    left = [_mix(ctx["rank"].astype(np.uint64), ctx["second"])]
    right = [np.full(len(ctx), 2, np.uint64)]
    with np.errstate(over="ignore"):
        for i in range(SIDE):
            left.append(_mix(left[-1] * _MULT, ctx["left"][:, i]))
            right.append(_mix(right[-1] * _MULT, ctx["right"][:, i]))
    for x in range(SIDE + 1):
        ok = np.nonzero((ctx["sizes"][:, 0] >= x) & (ctx["sizes"][:, 1] >= SIDE - x))[0]
        yield x, ok, _mix(_mix(left[x][ok], right[SIDE - x][ok]), np.uint64(x))


def _whole(ctx: np.ndarray) -> np.ndarray:
    """Bits of all offsets whose window lies inside the document."""
    bits = np.zeros(len(ctx), np.uint32)
    for x in range(SIDE + 1):
        bits[(ctx["sizes"][:, 0] >= x) & (ctx["sizes"][:, 1] >= SIDE - x)] |= np.uint32(1 << x)
    return bits


def _second_round(docs: pa.Table, held: pa.Table, buckets: int) -> pa.Table:
    """(bucket, batch, contexts, firsts, windows): distinct surroundings of the samples with repeated ranks and their least documents.

    A hot rank's surroundings go out window by window, each to the bucket of its own hash, so they never meet in one task.
    """
    schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("contexts", pa.binary()), ("firsts", pa.binary()), ("windows", pa.binary())])
    if not held.num_rows or not docs.num_rows:
        return schema.empty_table()
    wanted = np.frombuffer(b"".join(held.column("ranks").to_pylist()), np.uint64)
    hot = np.frombuffer(b"".join(held.column("hot").to_pylist()), bool)
    order = np.argsort(wanted)
    wanted, hot = wanted[order], hot[order]
    _, keys, buf, ends = _documents(docs)
    at, rank = samples(buf, ends)
    place = np.minimum(np.searchsorted(wanted, rank), len(wanted) - 1)
    found = wanted[place] == rank
    at, rank, place = at[found], rank[found], place[found]
    key = keys[np.searchsorted(ends, at, "right")]
    ctx = _contexts(buf, ends, at, rank)
    batch = docs.column("batch")[0].as_py()
    out = {n: [] for n in schema.names}
    cold, _, first = _distinct(ctx[~hot[place]], key[~hot[place]])
    for b, rows in _split(_bucket(cold["rank"], buckets)):
        firsts = np.zeros(len(rows), FIRST)
        firsts["key"] = first[rows]
        for name, value in zip(schema.names, (b, batch, _packed(cold[rows]), _packed(firsts), b""), strict=True):
            out[name].append(value)
    for b, rows in _held(ctx[hot[place]], key[hot[place]], buckets):
        for name, value in zip(schema.names, (b, batch, b"", b"", _packed(rows)), strict=True):
            out[name].append(value)
    return pa.table(out, schema=schema)


def _held(ctx: np.ndarray, key: np.ndarray, buckets: int):
    """Each bucket and its HELD windows, offset by offset."""
    for _, ok, window in _windows(ctx):
        order = np.lexsort((key[ok], window))
        w, k, r = window[order], key[ok][order], ctx["rank"][ok][order]
        start = np.nonzero(np.concatenate((np.ones(min(len(w), 1), bool), w[1:] != w[:-1])))[0]
        if not len(start):
            continue
        rows = np.zeros(len(start), HELD)
        rows["rank"], rows["window"], rows["key"] = r[start], w[start], k[start]
        rows["several"] = np.maximum.reduceat(k, start) > k[start]
        for b, part in _split(_bucket(rows["window"], buckets)):
            yield b, rows[part]


def _rerank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (a, b) in their order."""
    order = np.lexsort((b, a))
    new = np.concatenate(([False], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new)
    return out


def _least(classes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The least value of each row's class."""
    out = np.full(int(classes.max()) + 1 if len(classes) else 0, LAST, np.int64)
    np.minimum.at(out, classes, values)
    return out[classes]


def _verdicts(table: pa.Table) -> pa.Table:
    """(batch, said, seen): for each context of a batch the offsets x whose window an earlier document has, and hot windows' least documents."""
    schema = pa.schema([("batch", pa.int32()), ("said", pa.binary()), ("seen", pa.binary())])
    out = {n: [] for n in schema.names}
    batches = table.column("batch").to_pylist()
    for o, rows in _said(table):
        for name, value in zip(schema.names, (batches[o], _packed(rows), b""), strict=True):
            out[name].append(value)
    for o, rows in _seen(table):
        for name, value in zip(schema.names, (batches[o], b"", _packed(rows)), strict=True):
            out[name].append(value)
    return pa.table(out, schema=schema)


def _blocks(table: pa.Table, name: str, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """A column's blocks joined, and the table row that each of their rows comes from."""
    raw = [(i, _unpacked(x, kind)) for i, x in enumerate(table.column(name).to_pylist()) if x]
    owner = np.repeat(np.array([i for i, _ in raw], np.int32), [len(x) for _, x in raw])
    return np.concatenate([x for _, x in raw]) if raw else np.empty(0, kind), owner


def _said(table: pa.Table):
    """Each table row with contexts and its SAID rows."""
    blocks, owner = _blocks(table, "contexts", CONTEXT)
    firsts, _ = _blocks(table, "firsts", FIRST)
    if not len(blocks):
        return
    ctx, of, first = _distinct(blocks, firsts["key"])
    n = len(ctx)
    # ranks with 0 .. SIDE bytes to either side; a pair (x to the left, SIDE - x to the right) is past the threshold
    start = _rerank(ctx["rank"].astype(np.uint64), ctx["second"])
    lefts, rights = [start], [start]
    for i in range(SIDE):
        lefts.append(_rerank(lefts[-1], ctx["left"][:, i]))
        rights.append(_rerank(rights[-1], ctx["right"][:, i]))
    earlier = np.zeros(n, np.uint32)
    for x in range(SIDE + 1):
        ok = np.nonzero((ctx["sizes"][:, 0] >= x) & (ctx["sizes"][:, 1] >= SIDE - x))[0]
        if len(ok):
            least = _least(_rerank(lefts[x][ok], rights[SIDE - x][ok]), first[ok])
            earlier[ok[least < first[ok]]] |= np.uint32(1 << x)
    said = np.where(firsts["key"] > first[of], _whole(ctx)[of], earlier[of])
    code = _hash(ctx)[of]
    hit = np.nonzero(said)[0]
    for o, rows in _split(owner[hit]):
        rows = hit[rows]
        v = np.zeros(len(rows), SAID)
        v["rank"], v["context"], v["offsets"] = blocks["rank"][rows].astype(np.uint32), code[rows], said[rows]
        yield o, v


def _seen(table: pa.Table):
    """Each table row with hot windows and its SEEN rows."""
    w, owner = _blocks(table, "windows", HELD)
    order = np.lexsort((w["rank"], w["window"]))
    w, owner = w[order], owner[order]
    if not len(w):
        return
    new = np.concatenate(([True], (w["window"][1:] != w["window"][:-1]) | (w["rank"][1:] != w["rank"][:-1])))
    least = np.minimum.reduceat(w["key"], np.nonzero(new)[0])[np.cumsum(new) - 1]
    hit = np.nonzero((w["several"] > 0) | (w["key"] > least))[0]
    for o, rows in _split(owner[hit]):
        rows = hit[rows]
        v = np.zeros(len(rows), SEEN)
        v["rank"], v["window"], v["key"] = w["rank"][rows].astype(np.uint32), w["window"][rows], least[rows]
        yield o, v


def _found(among: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of values that stand in the sorted `among`, and where."""
    if not len(among) or not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    rows = np.nonzero(among[at] == values)[0]
    return rows, at[rows]


def _repeated_windows(held: pa.Table, keys: np.ndarray, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The samples that verdicts speak of, found again, and the bits of the offsets whose window an earlier document has."""
    at, rank = samples(buf, ends)
    said, _ = _blocks(held, "said", SAID)
    seen, _ = _blocks(held, "seen", SEEN)
    said, seen = said[np.argsort(said["context"])], seen[np.argsort(seen["window"])]
    low = rank.astype(np.uint32)
    ranks, count = _documents_of(rank, keys[np.searchsorted(ends, at, "right")])
    need = np.isin(low, said["rank"]) | np.isin(low, seen["rank"]) | (count[np.searchsorted(ranks, rank)] > 1)
    at, rank = at[need], rank[need]
    key = keys[np.searchsorted(ends, at, "right")]
    ctx, which, first = _distinct(_contexts(buf, ends, at, rank), key)
    # of equal contexts in a batch the first document has all windows of the others
    bits = np.where(key > first[which], _whole(ctx)[which], np.uint32(0))
    rows, where = _found(said["context"], _hash(ctx))
    offsets = np.zeros(len(ctx), np.uint32)
    offsets[rows] = said["offsets"][where]
    bits |= offsets[which]
    hot = np.nonzero(np.isin(ctx["rank"].astype(np.uint32), seen["rank"]))[0]
    for x, ok, window in _windows(ctx[hot]):
        rows, where = _found(seen["window"], window)
        least = np.full(len(ctx), LAST, np.int64)
        least[hot[ok[rows]]] = seen["key"][where]
        bits[key > least[which]] |= np.uint32(1 << x)
    return at, bits


def _removed(docs: pa.Table, held: pa.Table) -> pa.Table:
    """(key, n_bytes, n_removed, n_spans, kept): each document of a batch without the bytes of its repeated windows."""
    bodies, keys, buf, ends = _documents(docs)
    change = np.zeros(len(buf) + 1, np.int32)
    if len(buf) >= THRESHOLD:
        at, bits = _repeated_windows(held, keys, buf, ends)
        for x in range(SIDE + 1):
            p = at[(bits >> np.uint32(x)) & np.uint32(1) == 1] - x
            np.add.at(change, p, 1)
            np.add.at(change, p + THRESHOLD, -1)
    gone = np.cumsum(change[:-1]) > 0
    out = {"key": keys, "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
    lo = 0
    for body, hi in zip(bodies, ends.tolist(), strict=True):
        g = gone[lo:hi]
        out["n_bytes"].append(len(body))
        out["n_removed"].append(int(g.sum()))
        out["n_spans"].append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
        out["kept_sha256"].append(hashlib.sha256(buf[lo:hi][~g].tobytes()).hexdigest())
        lo = hi
    return pa.table(out, schema=pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row for each input row: id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts count as empty, and a null id as greater than any other. Rows of the same id never make each other lose
    bytes. The id must be a bigint below 2 ** 63 - 1.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.pmod(F.xxhash64(key), F.lit(parts * BATCHES)).cast("int").alias("batch"), key.alias("key"), body.alias("body"))
    by_batch = rows.groupBy("batch")
    ranks = by_batch.applyInArrow(lambda t: _first_round(t, parts), "bucket int, batch int, ranks binary, documents binary")
    repeated = ranks.groupBy("bucket").applyInArrow(lambda t: _repeated(t, hot), "batch int, ranks binary, hot binary")
    second = by_batch.cogroup(repeated.groupBy("batch")).applyInArrow(lambda a, b: _second_round(a, b, parts), "bucket int, batch int, contexts binary, firsts binary, windows binary")
    said = second.groupBy("bucket").applyInArrow(_verdicts, "batch int, said binary, seen binary")
    out = by_batch.cogroup(said.groupBy("batch")).applyInArrow(_removed, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    back = F.when(F.col("key") < LAST, F.col("key")).cast(docs.schema[id_col].dataType)
    return out.select(back.alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(load(spark, sf_dir, "documents"))
