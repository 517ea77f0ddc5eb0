"""Vector expressions over arrays, accumulated left to right in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once.

    An expression used inside a lambda is otherwise worked out again for every element.
    """
    return F.transform(F.array(value), body)[0]


def l2_normalise(vector: Column) -> Column:
    """Scale to unit length; a zero vector stays as it is."""

    def scale(wide: Column) -> Column:
        norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
        return bind(
            norm, lambda n: F.when(n > 0, F.transform(wide, lambda x: x / n)).otherwise(wide)
        )

    return bind(vector.cast("array<double>"), scale)


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
