"""Vectors and arg-max over arrays, on the JVM side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is. The norm is summed once a vector: inside ``transform`` it would be for each component."""
    unit = lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n > 0, F.sqrt(n)).otherwise(F.lit(1.0)))
    return F.aggregate(F.array(dot(a, a)), F.lit(0.0), lambda s, x: s + x, unit)


def greatest_of(terms: list[Column]) -> Column:
    """``greatest`` that also takes one term; nulls are passed over."""
    return terms[0] if len(terms) == 1 else F.greatest(*terms)


def first_largest(items: Column, field: str) -> Column:
    """The array element whose ``field`` is largest, the first of equals."""
    return F.reduce(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), items[0], lambda best, x: F.when(x[field] > best[field], x).otherwise(best))


def any_null(names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"`{n}`").isNull() for n in names])


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
