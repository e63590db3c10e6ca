"""Sampling, budgets and shares, all by digests: reproducible in any partitioning, with bounded top-k where a number is asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decisia.functions import rand
from decisia.sources.shared import durable


def reservoir(df: DataFrame, key: str, k: int, seed: int = 7) -> DataFrame:
    """k rows, each as likely as any other: the greatest draws."""
    return df.withColumn("u", rand.uniform(F.col(key), seed)).orderBy(F.col("u").desc(), key).limit(k)


def weighted_reservoir(df: DataFrame, key: str, weight: Column, k: int, seed: int = 7) -> DataFrame:
    """A-Res: the k greatest u^(1/w)."""
    return df.withColumn("draw", F.pow(rand.uniform(F.col(key), seed), F.lit(1.0) / weight)).orderBy(F.col("draw").desc(), key).limit(k)


def per_source(df: DataFrame, source: str, key: str, budgets: DataFrame, seed: int = 7) -> DataFrame:
    """As many rows of each source as budgets(source, budget) allows, by order key. A cut of the digest per source, found by counting,
    leaves only rows near it to be ranked, so that no source is ever sorted whole."""
    rows = df.withColumn("_o", rand.order_key(F.col(key), seed)).withColumn("_cell", F.substring("_o", 1, 3))
    counts = rows.groupBy(source, "_cell").agg(F.count("*").alias("_n")).join(budgets, source)
    upto = F.sum("_n").over(W.partitionBy(source).orderBy("_cell"))
    cells = counts.withColumn("_upto", upto).withColumn("_room", F.col("budget") - F.col("_upto") + F.col("_n")).where("_room > 0").select(source, "_cell", "_room", (F.col("_upto") <= F.col("budget")).alias("_whole"))
    near = rows.join(cells, [source, "_cell"])
    some = near.where(~F.col("_whole")).withColumn("_r", F.row_number().over(W.partitionBy(source, "_cell").orderBy("_o", key))).where(F.col("_r") <= F.col("_room")).drop("_r")
    return near.where("_whole").unionByName(some).drop("_o", "_cell", "_room", "_whole")


def soft_cap(df: DataFrame, soft: Column, key: str, share: float, seed: int = 7) -> DataFrame:
    """All hard rows, and of the soft ones at most the share of all rows, by order key."""
    rows = df.withColumn("_soft", soft)
    budget = rows.agg(F.floor(F.count("*") * F.lit(share)).cast("long").alias("budget")).withColumn("_all", F.lit(1))
    kept = per_source(rows.where("_soft").withColumn("_all", F.lit(1)), "_all", key, budget, seed)
    return rows.where(~F.col("_soft")).unionByName(kept.drop("_all")).drop("_soft")


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds row_number (from 0) over the whole order without one task for all rows: range partitions, counts of each, prefix sums."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # kept as a table, since ranges drawn anew for a second reading could differ
    ranged = durable(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    bases = counts.withColumn("_base", F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")).select("_part", "_base")
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_i", within).join(F.broadcast(bases), "_part").withColumn("row_number", F.col("_base") + F.col("_i")).drop("_part", "_base", "_i")


def strided(df: DataFrame, step: int, *order: str) -> DataFrame:
    return numbered(df, *order).where(F.col("row_number") % step == 0)


def rank_share(df: DataFrame, rank: int, world: int, *order: str) -> DataFrame:
    return numbered(df, *order).where(F.col("row_number") % world == rank)


def with_extremes(df: DataFrame, key: str, length: str, k: int, seed: int = 7) -> DataFrame:
    """A uniform sample, the longest row and the shortest."""
    ends = df.agg(F.max_by(key, F.struct(length, key)).alias("a"), F.min_by(key, F.struct(length, key)).alias("b")).select(F.explode(F.array("a", "b")).alias(key)).distinct()
    return reservoir(df, key, k, seed).drop("u").unionByName(df.join(F.broadcast(ends), key, "left_semi")).distinct()


#: Ranges that are sent to every task; more meet their points in a join by cells.
MOST_RANGES = 500_000


def in_ranges(points: DataFrame, value: Column, ranges: DataFrame, low: str, high: str) -> DataFrame:
    """Each row of points with each of ranges such that low <= value < high, by cells as wide as a range is on average.

    A range lies in as many cells as it reaches into, two a range on average, and a point looks into its own cell only; so points that are spread over the ranges' whole
    span meet about two ranges each, however unlike the ranges' widths, and the join is one of equal cells.
    """
    some = ranges.where(F.col(high) > F.col(low))
    ends = some.agg(F.min(low).cast("double").alias("a"), F.max(high).cast("double").alias("b"), F.avg(F.col(high) - F.col(low)).alias("w"), F.count("*").alias("n")).first()
    if not ends["n"]:
        return points.join(ranges, F.lit(False))
    first, width = float(ends["a"]), max(float(ends["w"]), (float(ends["b"]) - float(ends["a"])) / 2**31)
    cell = lambda c: F.floor((c.cast("double") - F.lit(first)) / F.lit(width))
    of_range = some.withColumn("_cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    of_range = F.broadcast(of_range) if ends["n"] <= MOST_RANGES else of_range
    asked = points.withColumn("_value", value)
    inside = asked.where((F.col("_value") >= ends["a"]) & (F.col("_value") < ends["b"])).withColumn("_cell", cell(F.col("_value")))
    return inside.join(of_range, "_cell").where((F.col("_value") >= F.col(low)) & (F.col("_value") < F.col(high))).drop("_cell", "_value")


def running(df: DataFrame, value: str, name: str, *order: str) -> DataFrame:
    """Adds the sum of value over the rows up to this one in an order that tells all rows apart: range partitions, the sum of each, prefix sums."""
    ranged = durable(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_s"))  # a row a partition
    bases = sums.withColumn("_base", F.sum("_s").over(W.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_s")).select("_part", "_base")
    upto = F.sum(value).over(W.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(name, upto).join(F.broadcast(bases), "_part").withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_base")


def weighted_choice(draws: DataFrame, key: str, weights: DataFrame, seed: int = 7) -> DataFrame:
    """With replacement: each row of draws gets the item of weights(item, weight) in whose cumulative range its draw falls."""
    total = F.lit(weights.agg(F.sum("weight")).first()[0])  # one number
    upto = running(weights, "weight", "_upto", "item")
    ranges = upto.select("item", ((F.col("_upto") - F.col("weight")) / total).alias("lo"), (F.col("_upto") / total).alias("hi"))
    return in_ranges(draws.withColumn("u", rand.uniform(F.col(key), seed)), F.col("u"), ranges, "lo", "hi").drop("lo", "hi")


def shuffled_take(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """The first n of a shuffle of all rows (a shuffle buffer would favour early ones)."""
    return df.withColumn("_o", rand.order_key(F.col(key), seed, "take")).orderBy("_o", key).limit(n).drop("_o")


def limited(df: DataFrame, group: str, n: int, *order: str) -> DataFrame:
    """At most n rows of each group, the first ones; each task keeps n before the exchange."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def in_scope(df: DataFrame, label: str, out_of_scope: tuple[str, ...]) -> DataFrame:
    """Rows whose label isn't one of those that ask for nothing; rows without a label go too."""
    return df.where(F.col(label).isNotNull() & ~F.col(label).isin(*out_of_scope))
