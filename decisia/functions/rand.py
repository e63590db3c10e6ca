"""Randomness from digests: the same key and seed give the same draw in any partitioning and in any engine that has MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = 4503599627370496.0


def order_key(key: Column, *salt: object) -> Column:
    """A digest to sort by: a shuffle that depends on key and salt only."""
    parts = [s.cast("string") if isinstance(s, Column) else F.lit(str(s)) for s in salt]
    return F.md5(F.concat_ws(":", key.cast("string"), *parts))


def uniform(key: Column, *salt: object) -> Column:
    """A double in [0, 1): 13 hex digits of the digest over 2^52."""
    return F.conv(F.substring(order_key(key, *salt), 1, 13), 16, 10).cast("long") / F.lit(TWO_52)


def randint(key: Column, low: int, high: int, *salt: object) -> Column:
    return (F.floor(uniform(key, *salt) * F.lit(high - low + 1)) + F.lit(low)).cast("int")


def permuted(items: Column, key: Column, *salt: object) -> Column:
    """The array in an order drawn from key: structs (h, i, item), i the place before."""
    return F.array_sort(F.transform(items, lambda x, i: F.struct(order_key(key, *salt, i).alias("h"), i.alias("i"), x.alias("item"))))
