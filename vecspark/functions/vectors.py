"""Vector and set expressions on array columns; all sums are sequential doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the Q1.15 format.
Q15_ONE = 32768
Q15_MAX = 32767


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda a, x: a + x * x))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: F.when(n > 0, x / n).otherwise(0.0))


def l2_squared(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def q15_encode(v: Column) -> Column:
    """Towards zero, at most 32767."""
    return F.transform(doubles(v), lambda x: F.least(F.lit(Q15_MAX), (x * Q15_ONE).cast("int")))


def q15_decode(q: Column) -> Column:
    return F.transform(q, lambda x: x / F.lit(float(Q15_ONE)))


def q15_dot(a: Column, b: Column, strict_i16: bool = False) -> Column:
    """Sum of rounded products (a * b + 2 ** 14) >> 15, wrapped to 16 bits if strict."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: F.shiftright(x * y + 16384, 15)), F.lit(0), lambda t, x: t + x)
    return F.pmod(s + Q15_ONE, F.lit(65536)) - Q15_ONE if strict_i16 else s


def sim_cosine(a: Column, b: Column) -> Column:
    """(dot + 1) / 2 of unit vectors."""
    return (dot(a, b) + 1) / 2


def sim_l2(a: Column, b: Column) -> Column:
    """1 / (1 + squared distance)."""
    return 1 / (1 + l2_squared(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays without repeats; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(0.0)


def distance_cosine(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def distance_euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def distance_hamming(a: Column, b: Column) -> Column:
    """Share of differing places of two boolean arrays."""
    return total(F.zip_with(a, b, lambda x, y: (x != y).cast("double"))) / F.size(a)


def distance_jaccard(a: Column, b: Column) -> Column:
    return 1 - jaccard(a, b)


def distance_valid(distance: Column) -> Column:
    """Jaccard distances that count as found."""
    return distance < 1 - 1e-5


def point_to_text(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: x.cast("string")), " ")


def text_to_floats(s: Column) -> Column:
    return F.transform(F.split(F.trim(s), " +"), lambda x: x.cast("float"))


def text_to_bits(s: Column) -> Column:
    return F.transform(F.split(F.trim(s), " +"), lambda x: x.cast("int") != 0)


def text_to_set(s: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.split(F.trim(s), " +"), lambda x: x.cast("long"))))
