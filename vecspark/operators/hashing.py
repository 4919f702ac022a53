"""Hash families and sources over seeded integer parameter tables.

Parameters are small integers drawn on the driver, so that codes are exact in any engine and in any partitioning. A
family turns a vector or set into `bits` bits a function; a source says how functions make up the `length`-bit hash of
each table. Codes are computed in Arrow batches with numpy (one matrix product a batch); the parameters' size depends
on tables and dimensions only.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.probability import binned_p, minhash_p, simhash_p

PRIME = 2147483647
SCALE = 1000
MATRIX = 256


class Family(Protocol):
    """A family of hash functions: draw() gives parameters, apply() codes of shape (rows, functions).

    collision() is the chance that two rows of a similarity agree in the leading bits of one function.
    """

    bits: int

    def draw(self, functions: int) -> object: ...
    def apply(self, rows: object, params: object) -> np.ndarray: ...
    def collision(self, sim: Column, bits: int) -> Column: ...


def prefix_collision(family: Family, sim: Column, depth: int) -> Column:
    """The chance that the leading `depth` bits of a table's hash agree: whole functions and a part of the next."""
    whole, rest = divmod(depth, family.bits)
    p = F.pow(family.collision(sim, family.bits), F.lit(float(whole))) if whole else F.lit(1.0)
    return p * family.collision(sim, rest) if rest else p


def q15(x: np.ndarray) -> np.ndarray:
    """Whole numbers, kept as doubles: all products and sums here stay below 2 ** 53, so they are exact."""
    return np.minimum(np.trunc(x * 32768.0), 32767.0)


@dataclass(frozen=True)
class SimHash:
    """Sign of the product with an integer hyperplane."""

    dim: int
    seed: int = 1
    bits: int = 1

    def draw(self, functions: int) -> np.ndarray:
        rng = random.Random(self.seed)
        return np.array([[rng.randint(-SCALE, SCALE) for _ in range(self.dim)] for _ in range(functions)], np.int64)

    def apply(self, rows: np.ndarray, params: np.ndarray) -> np.ndarray:
        return (q15(rows) @ params.T.astype(np.float64) >= 0).astype(np.int64)

    def collision(self, sim: Column, bits: int) -> Column:
        return F.pow(simhash_p(sim), F.lit(float(bits)))


@dataclass(frozen=True)
class CrossPolytope:
    """Index of the integer direction of largest absolute product, and its sign as the lowest bit (1 if negative)."""

    dim: int
    seed: int = 2
    samples: int = 4000
    eps: float = 5e-3

    @property
    def axes(self) -> int:
        return 1 << max(0, (self.dim - 1).bit_length())

    @property
    def bits(self) -> int:
        return max(0, (self.dim - 1).bit_length()) + 1

    def draw(self, functions: int) -> np.ndarray:
        rng = random.Random(self.seed)
        return np.array([[[rng.randint(-SCALE, SCALE) for _ in range(self.dim)] for _ in range(self.axes)] for _ in range(functions)], np.int64)

    def apply(self, rows: np.ndarray, params: np.ndarray) -> np.ndarray:
        q = q15(rows)
        return np.stack([_closest(q @ p.T.astype(np.float64)) for p in params], axis=1)

    def collision(self, sim: Column, bits: int) -> Column:
        return _estimated(self, sim, bits)


def _closest(products: np.ndarray) -> np.ndarray:
    axis = np.abs(products).argmax(axis=1)
    return 2 * axis + (products[np.arange(len(axis)), axis] < 0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, not normalised; the length is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), n)
        half *= 2
    return x


@dataclass(frozen=True)
class FHTCrossPolytope:
    """Cross-polytope after random signs and Hadamard transforms, `rotations` times."""

    dim: int
    seed: int = 3
    rotations: int = 3
    samples: int = 4000
    eps: float = 5e-3

    @property
    def axes(self) -> int:
        return 1 << max(0, (self.dim - 1).bit_length())

    @property
    def bits(self) -> int:
        return max(0, (self.dim - 1).bit_length()) + 1

    def draw(self, functions: int) -> np.ndarray:
        rng = random.Random(self.seed)
        return np.array([[[rng.choice((-1, 1)) for _ in range(self.axes)] for _ in range(self.rotations)] for _ in range(functions)], np.int64)

    def apply(self, rows: np.ndarray, params: np.ndarray) -> np.ndarray:
        q = np.zeros((len(rows), self.axes))
        q[:, : self.dim] = q15(rows)
        # up to MATRIX axes one matrix product is faster than the butterfly; both are exact
        whole = hadamard(np.eye(self.axes)) if self.axes <= MATRIX else None
        out = []
        for signs in params:
            y = q
            for s in signs:
                y = hadamard(y * s) if whole is None else (y * s) @ whole
            out.append(_closest(y))
        return np.stack(out, axis=1)

    def collision(self, sim: Column, bits: int) -> Column:
        return _estimated(self, sim, bits)


def _estimated(family: CrossPolytope | FHTCrossPolytope, sim: Column, bits: int) -> Column:
    table = cross_polytope_estimates(family.dim, family.samples, family.eps)
    return binned_p(sim, [table[bits, i] for i in range(int(1 / family.eps) + 1)], family.eps)


@dataclass(frozen=True)
class MinHash:
    """The token with the least (a x + b) mod PRIME (equal: the smaller token), its lowest bits; rows are lists of tokens."""

    universe: int
    seed: int = 4
    one_bit: bool = False

    @property
    def bits(self) -> int:
        return 1 if self.one_bit else max(1, (self.universe - 1).bit_length())

    def draw(self, functions: int) -> np.ndarray:
        rng = random.Random(self.seed)
        return np.array([[rng.randint(1, PRIME - 1), rng.randint(0, PRIME - 1)] for _ in range(functions)], np.int64)

    def apply(self, rows: list[np.ndarray], params: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(params)), np.int64)
        for i, tokens in enumerate(rows):
            if len(tokens):
                t = np.sort(tokens)
                out[i] = t[((params[:, :1] * t + params[:, 1:]) % PRIME).argmin(axis=1)]
        return out % 2 if self.one_bit else out & ((1 << self.bits) - 1)

    def collision(self, sim: Column, bits: int) -> Column:
        return minhash_p(sim, self.universe, bits)


@dataclass(frozen=True)
class Independent:
    """Functions of its own for each table."""

    tables: int
    length: int

    def functions(self, bits: int) -> int:
        return self.tables * -(-self.length // bits)

    def combine(self, codes: np.ndarray, bits: int) -> np.ndarray:
        per = -(-self.length // bits)
        return np.stack([_joined(codes[:, t * per : (t + 1) * per], bits, self.length) for t in range(self.tables)], axis=1)

    def failure(self, family: Family, sim: Column, depth: int) -> Column:
        """The chance that a pair of this similarity shares `depth` leading bits in no table."""
        return F.pow(1 - prefix_collision(family, sim, depth), F.lit(float(self.tables)))


@dataclass(frozen=True)
class Pool:
    """Each table draws its functions from one pool, with replacement; the pool's codes are computed once a row."""

    tables: int
    length: int
    pool_bits: int = 3000
    seed: int = 5

    def functions(self, bits: int) -> int:
        return max(1, self.pool_bits // bits)

    def choices(self, bits: int) -> list[list[int]]:
        rng = random.Random(self.seed)
        n, per = self.functions(bits), -(-self.length // bits)
        return [[rng.randrange(n) for _ in range(per)] for _ in range(self.tables)]

    def combine(self, codes: np.ndarray, bits: int) -> np.ndarray:
        return np.stack([_joined(codes[:, c], bits, self.length) for c in self.choices(bits)], axis=1)

    def failure(self, family: Family, sim: Column, depth: int) -> Column:
        return F.pow(1 - prefix_collision(family, sim, depth), F.lit(float(self.tables)))


@dataclass(frozen=True)
class Tensor:
    """Tables are pairs of left and right half hashes whose bits alternate, the left one's first."""

    tables: int
    length: int

    @property
    def halves(self) -> int:
        return math.isqrt(self.tables - 1) + 1 if self.tables else 0

    def functions(self, bits: int) -> int:
        return 2 * self.halves * -(-((self.length + 1) // 2) // bits)

    def pairs(self) -> list[tuple[int, int]]:
        out = []
        for i in range(self.tables):
            r = math.isqrt(i)
            rest = i - r * r
            out.append((rest, r) if rest < r else (r, rest - r))
        return out

    def combine(self, codes: np.ndarray, bits: int) -> np.ndarray:
        size = (self.length + 1) // 2
        per = -(-size // bits)
        half = [_joined(codes[:, i * per : (i + 1) * per], bits, size) for i in range(2 * self.halves)]
        out = []
        for a, b in self.pairs():
            h = np.zeros(len(codes), np.int64)
            for i in range(size):
                h |= ((half[a] >> i & 1) << (2 * i + 1)) | ((half[self.halves + b] >> i & 1) << (2 * i))
            out.append(h >> (2 * size - self.length))
        return np.stack(out, axis=1)

    def failure(self, family: Family, sim: Column, depth: int) -> Column:
        """A left and a right half must agree; halves beyond the largest full square are not counted."""
        n = F.lit(float(math.isqrt(self.tables)))
        met = [1 - F.pow(1 - prefix_collision(family, sim, bits), n) for bits in ((depth + 1) // 2, depth // 2)]
        return 1 - met[0] * met[1]


def _joined(codes: np.ndarray, bits: int, length: int) -> np.ndarray:
    """Codes one after the other, the first highest, cut to the leading bits."""
    out = np.zeros(len(codes), np.int64)
    for i in range(codes.shape[1]):
        out = out << bits | codes[:, i]
    return out >> (codes.shape[1] * bits - length)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def in_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := kernel(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def hash_codes(df: DataFrame, family: Family, source, sets: bool = False) -> DataFrame:
    """Rows (table_id, id, h) for rows (id, vec) or (id, tokens)."""
    params = family.draw(source.functions(family.bits))

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64) for x in b.column(1)] if sets else matrix(b.column(1))
        h = source.combine(family.apply(rows, params), family.bits)
        n, tables = h.shape
        return pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), b.column(0).take(pa.array(np.repeat(np.arange(n), tables))), pa.array(h.reshape(-1))], names=["table_id", "id", "h"])

    return in_batches(df, kernel, "table_id int, id long, h long")


def sketches(df: DataFrame, dim: int, count: int = 16, words: int = 1, seed: int = 6) -> DataFrame:
    """Rows (id, sketch_no, w0 ..): `count` SimHash sketches of 64 * words bits each."""
    family = SimHash(dim, seed)
    params = family.draw(count * words * 64)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        bits = family.apply(matrix(b.column(1)), params).astype(np.uint8).reshape(b.num_rows * count, words, 64)
        packed = np.packbits(bits, axis=2, bitorder="little").view(np.int64).reshape(b.num_rows * count, words)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), count))), pa.array(np.tile(np.arange(count, dtype=np.int32), b.num_rows)), *(pa.array(packed[:, w]) for w in range(words))], names=["id", "sketch_no", *(f"w{w}" for w in range(words))])

    return in_batches(df, kernel, "id long, sketch_no int, " + ", ".join(f"w{w} long" for w in range(words)))


@lru_cache(maxsize=16)
def cross_polytope_estimates(dim: int, samples: int = 1000, eps: float = 5e-3, seed: int = 8) -> dict[tuple[int, int], float]:
    """P(the leading b bits collide) by (b, similarity bin), from sampled pairs; bins are eps wide on [0, 1].

    By symmetry a pair of a cosine is (g, cos g + sin h) in a random frame. All bins use the same g and h.
    """
    rng = np.random.default_rng(seed)
    bits = max(0, (dim - 1).bit_length()) + 1
    axes = 1 << (bits - 1)
    out: dict[tuple[int, int], float] = {}
    step = max(1, (1 << 22) // axes)  # at most so many pairs at a time
    sizes = [min(step, samples - at) for at in range(0, samples, step)]
    for size in sizes:
        g, h = rng.normal(size=(2, size, axes))
        a = _closest(g)
        for bin_no in range(int(1 / eps) + 1):
            cos = 2 * min(1.0, bin_no * eps) - 1
            b = _closest(cos * g + math.sqrt(max(0.0, 1 - cos * cos)) * h)
            for n in range(bits + 1):
                out[n, bin_no] = out.get((n, bin_no), 0.0) + float(((a >> (bits - n)) == (b >> (bits - n))).sum()) / samples
    return out
