"""Numeric column expressions."""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax_first(scores: Column) -> Column:
    """0-based place of the largest score, the first on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("long")


def baseline_held(scores: Column, baseline: Column) -> Column:
    """Whether no option beats the baseline; ties hold."""
    return F.get(scores, baseline.cast("int")) >= F.array_max(scores)


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    """(low, high) of the score interval, within 0 and 1; null for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = successes / n
    mid, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (mid - spread) / (1 + z * z / n), (mid + spread) / (1 + z * z / n)
    return F.struct(F.when(n.isNotNull(), F.greatest(F.lit(0.0), low)).alias("low"), F.when(n.isNotNull(), F.least(F.lit(1.0), high)).alias("high"))


def binomial_tail(n: int, k: int, p: Column) -> Column:
    """P(X >= k) of n trials of chance p."""
    return reduce(Column.__add__, (comb(n, i) * F.pow(p, F.lit(i)) * F.pow(1 - p, F.lit(n - i)) for i in range(k, n + 1)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """0 where a class is neither predicted nor there."""
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def hash_uniform(*keys: Column) -> Column:
    """A number in [0, 1) from a digest of the keys; the same in any engine and partitioning."""
    digest = F.md5(F.concat_ws("|", *(k.cast("string") for k in keys)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
