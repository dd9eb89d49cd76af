"""Vector columns: an array of numbers in, ``array<double>`` or a double out.

Arguments are bound with ``let`` first: an encoder's vector is an expensive
expression, and naming it twice would evaluate it twice.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from clauseloom.functions.text import let


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
                       F.lit(0.0), lambda total, x: total + x)


def unit(vector: Column) -> Column:
    """Scaled to length one; a zero vector stays zero."""
    def scaled(v: Column) -> Column:
        return let(F.sqrt(dot(v, v)), lambda norm: F.when(norm == 0, v).otherwise(
            F.transform(v, lambda x: x / norm)))

    return let(F.transform(vector, lambda x: x.cast("double")), scaled)


def pooled(vectors: Column) -> Column:
    """Sum of an array of vectors, scaled to length one."""
    def total(parts: Column) -> Column:
        first = F.transform(F.get(parts, F.lit(0)), lambda x: x.cast("double"))
        return unit(F.aggregate(
            F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), first,
            lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double"))))

    return let(vectors, total)
