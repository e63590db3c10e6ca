"""Arithmetic on arrays of doubles, folded from left to right, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def softmax(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / total(e))


def normalised(v: Column) -> Column:
    """Sums to one; all alike where the sum is zero."""
    return F.transform(v, lambda x: F.when(total(v) > 0, x / total(v)).otherwise(F.lit(1.0) / F.size(v)))


def argmax(v: Column) -> Column:
    """Place of the first greatest entry, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def one_hot(size: Column, at: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i == at, 1.0).otherwise(0.0))


def cumulative(v: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(v)), lambda i: total(F.slice(v, 1, i)))


def entropy(v: Column, least: float = 1e-9) -> Column:
    return -total(F.transform(v, lambda x: x * F.ln(F.greatest(x, F.lit(least)))))
