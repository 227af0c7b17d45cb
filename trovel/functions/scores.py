"""Scalar formulas of retrieval, fusion and comparison; vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Differences up to this are ties.
TOLERANCE = 1e-12


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in double, summed from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: str | Column) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def idf(n: Column, freq: Column) -> Column:
    return F.log(1 + n / (1 + freq))


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def discounted(grade: Column, rank: Column) -> Column:
    return gain(grade) / F.log2(rank + 1)


def rrf(rank: Column, k: int = 60) -> Column:
    """Reciprocal rank term; a missing rank gives 0."""
    return F.coalesce(1 / (k + rank), F.lit(0.0))


def origin(a: Column, b: Column, both: str, only_a: str, only_b: str) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), both).when(a.isNotNull(), only_a).when(b.isNotNull(), only_b)


def winner(delta: Column, a: str = "a", b: str = "b", tie: str = "tie") -> Column:
    return F.when(delta > TOLERANCE, b).when(delta < -TOLERANCE, a).otherwise(tie)


def relative_change(a: Column, delta: Column) -> Column:
    return 100 * delta / F.nullif(a, F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """Null over nothing."""
    return part / F.nullif(whole, F.lit(0))
