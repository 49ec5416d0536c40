"""Vector arithmetic on ARRAY<DOUBLE> columns, all within JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(a: str | Column) -> Column:
    return F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def dist2(a: str | Column, b: str | Column) -> Column:
    """Squared distance as a sum of squared differences, never below zero."""
    return total(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)))


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: str | Column, by: Column) -> Column:
    return F.transform(_col(a), lambda x: x * by)


def added(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def softmax(a: str | Column) -> Column:
    """Row softmax, shifted by the maximum, with 1e-12 added to the denominator."""
    e = F.transform(_col(a), lambda x: F.exp(x - F.array_max(_col(a))))
    return F.transform(e, lambda x: x / (total(e) + 1e-12))


def argmax(a: str | Column) -> Column:
    """Place of the greatest value from 0; of equal ones the first."""
    return (F.array_position(_col(a), F.array_max(_col(a))) - 1).cast("int")


def element_sums(a: str | Column, width: int, weight: Column | None = None) -> list[Column]:
    """One sum for each place of an array column, of its product with the weight if given; a group by then combines partial sums before the shuffle."""
    times = (lambda x: x) if weight is None else (lambda x: weight * x)
    return [F.sum(times(F.get(_col(a), F.lit(i)))).alias(f"_{i}") for i in range(width)]
