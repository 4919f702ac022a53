"""Bit expressions on hash codes and packed words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def gray_to_binary(v: Column) -> Column:
    """Of codes up to 32 bits."""
    for s in (16, 8, 4, 2, 1):
        v = v.bitwiseXOR(F.shiftright(v, s))
    return v


def common_prefix(a: Column, b: Column, bits: int) -> Column:
    """Number of leading bits in common of two codes of so many bits."""
    x = a.bitwiseXOR(b)
    return F.when(x == 0, bits).otherwise(bits - F.length(F.bin(x)))


def interleave_zero(v: Column, bits: int = 16) -> Column:
    """Moves bit i to bit 2 i."""
    return reduce(lambda a, i: a.bitwiseOR(F.shiftleft(F.shiftright(v.cast("long"), i).bitwiseAND(F.lit(1).cast("long")), 2 * i)), range(bits), F.lit(0).cast("long"))


def index_pair(i: Column) -> tuple[Column, Column]:
    """Pairs in order of their larger part: (0,0), (0,1), (1,0), (1,1), (0,2) ..."""
    root = F.floor(F.sqrt(i.cast("double"))).cast("long")
    rest = i - root * root
    low = rest < root
    # 2 r + 1 pairs have r as their larger part: (0, r) .. (r - 1, r), then (r, 0) .. (r, r)
    return F.when(low, rest).otherwise(root), F.when(low, root).otherwise(rest - root)


def pack(bits: Column, word: int, size: int) -> Column:
    """Places 64 word .. of a boolean array as a bigint, the first place lowest."""
    parts = [F.when(F.get(bits, 64 * word + i), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(0).cast("long") for i in range(min(64, size - 64 * word))]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Differing bits of packed words."""
    return reduce(lambda x, y: x + y, (F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)))


def ceil_log2(v: int) -> int:
    return max(0, (v - 1).bit_length())
