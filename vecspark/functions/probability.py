"""Collision and failure probabilities of the hash families and sources."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def simhash_p(sim: Column) -> Column:
    """One bit, for the similarity (dot + 1) / 2."""
    return 1 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * sim - 1))) / math.pi


def minhash_p(sim: Column, universe: int, bits: int) -> Column:
    """The kept bits of the least token."""
    shown = min(2**bits, universe)
    return sim + (1 - sim) * ((universe / shown - 1) / universe)


def binned_p(sim: Column, values: list[float], eps: float) -> Column:
    """Of a family without a formula: the sampled value of the similarity's bin, which is not above the true one."""
    bin_no = F.greatest(F.lit(0), F.least(F.lit(len(values) - 1), F.floor(sim / eps + 1e-9))).cast("int")
    return F.element_at(F.lit([float(v) for v in values]), bin_no + 1)


def concatenated_p(p: Column, bits: int, per_function: int = 1) -> Column:
    """Of a hash of so many bits; the part of a function that is left over counts as a whole one."""
    return F.pow(p, F.lit(float(bits // per_function + 1)))


def failure_pool(p_now: Column, p_deeper: Column, done: Column, tables: Column) -> Column:
    """Nothing found in `done` tables at this depth and the rest one deeper."""
    return F.pow(1 - p_now, done) * F.pow(1 - p_deeper, tables - done)


def failure_tensor(p: Column, depth: int, done: Column, tables: Column) -> Column:
    """Failure of tables that are all pairs of left and right half hashes. p: one bit's collision probability.

    A block of a left and b right halves finds nothing unless one of each side collides. The pairs done so far form a
    square block at this depth; one bit deeper there are that square, the further left halves with it, and the square of
    the further halves.
    """

    def block(bits: int, lefts: Column, rights: Column) -> Column:
        sides = ((bits + 1) // 2, lefts), (bits // 2, rights)
        hit_left, hit_right = (1 - F.pow(1 - concatenated_p(p, n), halves) for n, halves in sides)
        return 1 - hit_left * hit_right

    square = F.floor(F.sqrt(done.cast("double")))
    more = F.floor(F.sqrt(tables.cast("double"))) - square
    return block(depth, square, square) * block(depth + 1, square, square) * block(depth + 1, more, square) * block(depth + 1, more, more)
