"""Vector expressions over ARRAY columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _wide(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_wide(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def quantize(v: Column, bits: int = 8) -> Column:
    """struct(codes ARRAY<INT>, low, high): codes 0..2^bits-1, rounded half to even; a constant vector gets zeros."""
    w = _wide(v)
    low, high = F.array_min(w), F.array_max(w)
    scale = F.when(high > low, F.lit(float(2**bits - 1)) / (high - low)).otherwise(0.0)
    return F.struct(F.transform(w, lambda x: F.bround((x - low) * scale).cast("int")).alias("codes"), low.alias("low"), high.alias("high"))


def dequantize(codes: Column, low: Column, high: Column, bits: int = 8) -> Column:
    return F.transform(codes, lambda x: x * ((high - low) / float(2**bits - 1)) + low)
