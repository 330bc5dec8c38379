"""Column expressions over vectors (arrays of numbers); all arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, b: a + b)


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm_sq(a: Column) -> Column:
    return total(F.transform(doubles(a), lambda x: x * x))


def norm(a: Column) -> Column:
    return F.sqrt(norm_sq(a))


def unit(a: Column) -> Column:
    """The vector divided by its norm; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(doubles(a), lambda x: x / n)).otherwise(doubles(a))


def angular(a: Column, b: Column) -> Column:
    """2 - 2 cos, and 2 if either vector is zero."""
    n = norm_sq(a) * norm_sq(b)
    return F.when(n > 0, 2 - 2 * dot(a, b) / F.sqrt(n)).otherwise(F.lit(2.0))


def l2sq_2d(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def clip(x: Column, bound: float = 1.0) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), x))


def angle(x: Column, y: Column) -> Column:
    return F.atan2(y, x)


def exactly(x: Column) -> Column:
    """A number to 1e-14, so that sums do not depend on the order in which rows come."""
    return x.cast("decimal(28,14)")


def steady_sum(x: Column) -> Column:
    return F.sum(exactly(x)).cast("double")


def steady_avg(x: Column) -> Column:
    return F.sum(exactly(x)).cast("double") / F.count(x)


METRICS = {"l2": l2sq, "angular": angular}
