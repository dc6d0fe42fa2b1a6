"""Factorisation and triangular solves of one block, as a single higher-order expression over array<array<double>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _steps(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def _width(m: Column) -> Column:
    return F.coalesce(F.size(F.get(m, F.lit(0))), F.lit(0))


def transpose(m: Column) -> Column:
    return F.transform(_steps(_width(m)), lambda j: F.transform(m, lambda row: F.get(row, j)))


def _divisor(pivot: Column) -> Column:
    """pivot, failing at run time on 0."""
    return F.when(pivot == 0, F.raise_error(F.lit("a pivot is 0")).cast("double")).otherwise(pivot)


def getrf(m: Column) -> Column:
    """LU without pivoting, in place: L strictly below the diagonal (its own is 1), U on and above it. A pivot of 0 fails."""

    def eliminate(acc, k):
        pivot = F.get(acc, k)

        def below(row, i):
            f = F.get(row, k) / _divisor(F.get(pivot, k))
            return F.when(i <= k, row).otherwise(F.transform(row, lambda x, j: F.when(j < k, x).when(j == k, f).otherwise(x - f * F.get(pivot, j))))

        return F.transform(acc, below)

    return F.aggregate(_steps(F.least(F.size(m), _width(m))), m, eliminate)


def trsml(b: Column, l: Column) -> Column:
    """X of L X = B, L unit lower triangular."""

    def step(acc, k):
        done = F.get(acc, k)
        return F.transform(acc, lambda row, i: F.when(i <= k, row).otherwise(F.zip_with(row, done, lambda x, y: x - F.get(F.get(l, i), k) * y)))

    return F.aggregate(_steps(F.size(b)), b, step)


def trsmr(b: Column, u: Column) -> Column:
    """X of X U = B, U upper triangular with its own diagonal. A pivot of 0 fails."""

    def step(acc, k):
        pivot = F.get(u, k)

        def solve(row):
            x = F.get(row, k) / _divisor(F.get(pivot, k))
            return F.transform(row, lambda v, j: F.when(j < k, v).when(j == k, x).otherwise(v - x * F.get(pivot, j)))

        return F.transform(acc, solve)

    return F.aggregate(_steps(_width(b)), b, step)


def trsmr_stored_transposed(b: Column, u: Column) -> Column:
    """As trsmr, with B and X stored transposed."""
    return transpose(trsmr(transpose(b), u))


def lower(lu: Column) -> Column:
    return F.transform(lu, lambda row, i: F.transform(row, lambda x, j: F.when(j < i, x).when(j == i, 1.0).otherwise(0.0)))


def upper(lu: Column) -> Column:
    return F.transform(lu, lambda row, i: F.transform(row, lambda x, j: F.when(j >= i, x).otherwise(0.0)))
