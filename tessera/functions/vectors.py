"""Column functions on vectors held as arrays; computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; null when a vector is null or the lengths differ in non-null parts."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 where either vector is shorter than 1e-9."""
    return F.when((norm(a) < 1e-9) | (norm(b) < 1e-9), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def cosine_eps(a: Column, b: Column) -> Column:
    """Cosine with 1e-9 added to the denominator."""
    return dot(a, b) / (norm(a) * norm(b) + 1e-9)


def unit(a: Column) -> Column:
    """The vector at length 1; unchanged where it is shorter than 1e-9."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 1e-9, x.cast("double") / n).otherwise(x.cast("double")))


def composite(definition: Column, usage: Column, relational: Column, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> Column:
    """Weighted sum of three facet vectors at length 1."""
    wd, wu, wr = weights
    two = F.zip_with(definition, usage, lambda x, y: x.cast("double") * wd + y.cast("double") * wu)
    return unit(F.zip_with(two, relational, lambda x, y: x + y.cast("double") * wr))
