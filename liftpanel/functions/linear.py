"""Small linear systems as column expressions: one row holds the matrix of one run, a fold works on it.

A matrix is an array of rows. Expressions that are used more than once go through ``let``: Spark may copy a column's
expression to every place that names it, also into loops, but it cannot copy what a lambda's variable stands for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pivot below this is a regressor that the ones before it explain; matrices are of columns scaled to about 1.
LEAST_PIVOT = 1e-8


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def numbers(first: Column | int, last: Column | int) -> Column:
    """Whole numbers from ``first`` to ``last``, none if there are none."""
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def products(vector: Column) -> Column:
    """Products of all pairs of elements, the upper triangle row by row."""
    row = lambda v, i: F.transform(F.slice(vector, i + 1, F.size(vector) - i), lambda w: v * w)
    return F.flatten(F.transform(vector, row))


def square(triangle: Column, size: Column) -> Column:
    """The symmetric matrix whose upper triangle is given."""

    def cell(i: Column, j: Column) -> Column:
        low, high = F.least(i, j), F.greatest(i, j)
        return F.get(triangle, (low * size - (low * (low - 1) / 2).cast("int") + high - low).cast("int"))

    places = numbers(0, size - 1)
    return F.transform(places, lambda i: F.transform(places, lambda j: cell(i, j)))


def sweep(matrix: Column, k: Column) -> Column:
    """Gauss-Jordan step in place. On a matrix of products of regressors and a target, the steps of some regressors
    leave the inverse of their block, their coefficients in the target's column and its squared rest in the corner.
    A regressor that the earlier ones explain is passed over."""

    def swept(pivot: Column) -> Column:
        def cell(row: Column, v: Column, i: Column, j: Column) -> Column:
            elsewhere = v - F.get(row, k) * F.get(F.get(matrix, k), j) / pivot
            return F.when((i == k) & (j == k), 1 / pivot).when(i == k, v / pivot).when(j == k, -v / pivot).otherwise(elsewhere)

        done = F.transform(matrix, lambda row, i: F.transform(row, lambda v, j: cell(row, v, i, j)))
        return F.when(F.abs(pivot) > LEAST_PIVOT, done).otherwise(matrix)

    return let(F.get(F.get(matrix, k), k), swept)


def soft_threshold(x: Column, by: float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - by, F.lit(0.0))
