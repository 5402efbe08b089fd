"""Column functions over embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, not clipped; 0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def to_int8(v: Column) -> Column:
    """Rounds 127 times each component half to even, within -128 and 127."""
    return F.transform(v, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.bround(x.cast("double") * 127).cast("int"))))


def from_int8(v: Column) -> Column:
    return F.transform(v, lambda x: x / 127.0)


def to_bits(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x > 0, 1).otherwise(0))


def from_bits(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x > 0, 1.0).otherwise(-1.0))


def hamming_score(a: Column, b: Column) -> Column:
    """1 / (1 + number of differing bits)."""
    return 1 / (1 + F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x))
