"""First-wins dedup, overlap with other sets, duplicate audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Of rows with one key, the first in the order. Every task keeps the first of each key before the exchange, so a hot key costs nothing."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def not_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def overlap(df: DataFrame, group: str, key: str, keys: DataFrame, id_col: str, examples: int = 20) -> DataFrame:
    """group, rows, overlap, examples (least ids): how many keys of each group are in the other set; a group without any has 0."""
    hit = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    found = df.select(group, key, F.col(id_col).alias("_id")).join(hit, key, "left")
    counts = found.groupBy(group).agg(F.count("*").alias("rows"), F.count("_hit").alias("overlap"))
    least = found.where("_hit").select(group, "_id").distinct().withColumn("_place", F.row_number().over(W.partitionBy(group).orderBy("_id"))).where(F.col("_place") <= examples)
    listed = least.groupBy(F.col(group).alias("_group")).agg(F.array_sort(F.collect_list("_id")).alias("examples"))
    none = F.array().cast(dict(df.select(F.array(id_col).alias("a")).dtypes)["a"])
    return counts.join(listed, F.col(group).eqNullSafe(F.col("_group")), "left").select(group, "rows", "overlap", F.coalesce("examples", none).alias("examples"))


def across(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that more than one group has."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(group)).alias("groups")).where(F.size("groups") > 1)


def pair_counts(df: DataFrame, key: str, group: str, *order: str) -> DataFrame:
    """(group of the first, group of the later) and how many later copies."""
    first = df.groupBy(key).agg(F.min_by(F.struct(F.col(group).alias("g"), *order), F.struct(*order)).alias("f"), F.count("*").alias("n")).where("n > 1")
    later = df.join(first, key).where(F.struct(*order) != F.struct(*(F.col(f"f.{o}") for o in order)))
    return later.groupBy(F.col("f.g").alias("first_group"), F.col(group).alias("later_group")).agg(F.count("*").alias("copies"))


def duplicate_summary(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_keys"), F.sum(F.col("n") - 1).alias("duplicates"), F.round(100 * F.sum(F.col("n") - 1) / F.sum("n"), 4).alias("percent"))


def within_and_across(df: DataFrame, key: str, group: str, *order: str) -> DataFrame:
    """A group's rows that repeat one of the same group, and those that repeat any earlier row: a row can count in both.

    Counts only: each task combines rows of one key and group, so a frequent key is never ranked in one place.
    """
    each = df.groupBy(key, group).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    inside = each.groupBy(group).agg(F.sum(F.col("_n") - 1).alias("dup_in_group"), F.sum("_n").alias("_rows"))
    firsts = each.groupBy(key).agg(F.min_by(F.struct(F.col(group).alias("g")), "_first").alias("_f")).groupBy(F.col("_f.g").alias("_g")).agg(F.count("*").alias("_firsts"))
    both = inside.join(firsts, F.col(group).eqNullSafe(F.col("_g")), "left")
    return both.select(group, "dup_in_group", (F.col("_rows") - F.coalesce("_firsts", F.lit(0))).alias("dup_anywhere"))
