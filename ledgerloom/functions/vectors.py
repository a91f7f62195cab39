"""Column expressions on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """Cosine similarity; a zero vector is like nothing. Rounded, so that ties are ties on every engine. Norms that are known needn't be computed."""
    both = (norm(a) if a_norm is None else a_norm) * (norm(b) if b_norm is None else b_norm)
    return F.round(F.coalesce(F.try_divide(dot(a, b), both), F.lit(0.0)), 12)


def total(vectors: Column) -> Column:
    """The sum of an array of vectors, element by element."""
    return F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))), F.element_at(vectors, 1), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))


def mean(vectors: Column) -> Column:
    """The mean of an array of vectors, element by element."""
    return F.transform(total(vectors), lambda x: x / F.size(vectors))
