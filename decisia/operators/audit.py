"""Audits of decision rows: counters in one pass, shares, positional bias, lexical shortcuts, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decisia.functions import text
from decisia.functions.once import once
from decisia.functions.vectors import argmax, total


def verify(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """One row a group with every counter. rows: parsed decision rows with qtype, keys, probs, state, norm and a key column."""
    from decisia.operators.dedup import within_and_across

    p = F.col("probs")
    rows = once(rows, state=F.col("state"), norm=F.col("norm"), key=F.col("key"))
    counted = once(rows, _low=F.lower("state")).groupBy(group).agg(
        F.count("*").alias("rows"),
        F.count_if(F.abs(total(p) - 1) > 1e-6).alias("bad_gold_sum"),
        F.count_if(((F.col("qtype") == "choice") & ~F.size(p).between(2, 16)) | ((F.col("qtype") == "noul") & (F.array_sort("keys") != F.array(F.lit("false"), F.lit("true"))))).alias("bad_arity"),
        F.count_if(text.has_leak(F.col("state"), "audit", F.col("_low"))).alias("leak"),
        F.count_if(text.forbidden_key(F.col("state"))).alias("forbidden_key"),
        F.count_if(F.length("norm") < 10).alias("empty_state"),
    )
    return counted.join(within_and_across(rows, "key", group, *order), group)


def grouped_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Counts by each column on its own, in one pass: dimension, value, n."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def accounting(df: DataFrame, source: str, kept: Column) -> DataFrame:
    """Rows in, out and dropped by source, and in total (null source)."""
    return df.rollup(source).agg(F.count("*").alias("rows_in"), F.count_if(kept).alias("rows_out"), F.count_if(~kept).alias("dropped"))


def shares(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k commonest values with their shares of all rows; ties by value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    all_rows = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(all_rows)).select(column, "n", F.round(F.col("n") / F.col("total"), 4).alias("share")).orderBy(F.col("n").desc(), column).limit(k)


def position_bias_seen(df: DataFrame, arity: str, position: str) -> DataFrame:
    """By arity: the greatest distance of a position's share from one over the number of positions seen."""
    c = df.groupBy(arity, position).agg(F.count("*").alias("n"))
    by = W.partitionBy(arity)
    far = F.abs(F.col("n") / F.sum("n").over(by) - F.lit(1.0) / F.count("*").over(by))
    return c.withColumn("far", far).groupBy(arity).agg(F.sum("n").alias("rows"), F.round(F.max("far"), 4).alias("deviation"))


def position_bias(df: DataFrame, namespace: str, arity: str, position: str) -> DataFrame:
    """By namespace and arity: the same from one over the arity; positions never seen don't count."""
    c = df.groupBy(namespace, arity, position).agg(F.count("*").alias("n"))
    far = F.abs(F.col("n") / F.sum("n").over(W.partitionBy(namespace, arity)) - F.lit(1.0) / F.col(arity))
    return c.withColumn("far", far).groupBy(namespace, arity).agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_gold"), F.round(F.max("far"), 4).alias("deviation"))


def key_namespace(keys: Column) -> Column:
    """letter where the keys are A, B, C in turn, else name."""
    letters = F.transform(F.sequence(F.lit(1), F.size(keys)), lambda i: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), i, F.lit(1)))
    return F.when(keys == letters, "letter").otherwise("name")


def key_orders(df: DataFrame, workflow: str, keys: str, most: int = 200) -> DataFrame:
    """Distinct orders of keys by workflow, up to a limit of report, and how many rows have them sorted."""
    return df.groupBy(workflow).agg(F.least(F.count_distinct(F.array_join(keys, "\u0001")), F.lit(most)).alias("orders"), F.count_if(F.col(keys) == F.array_sort(keys)).alias("alphabetical"), F.count("*").alias("rows"))


def shortcuts(df: DataFrame, state_text: Column, options: Column, gold: Column) -> DataFrame:
    """How often, and by how many words, the gold option and the others share words with the state."""
    rows = df.select(text.tokens(state_text).alias("s"), options.alias("o"), gold.alias("g"))
    each = rows.select("s", "g", F.posexplode("o").alias("i", "option")).withColumn("shared", F.size(F.array_intersect(text.tokens(F.col("option")), "s")))
    is_gold = F.col("i") == F.col("g")
    mean = lambda cond, value: F.round(F.avg(F.when(cond, value)), 6)
    return each.agg(
        mean(is_gold, (F.col("shared") > 0).cast("double")).alias("gold_rate"), mean(~is_gold, (F.col("shared") > 0).cast("double")).alias("other_rate"),
        mean(is_gold, F.col("shared").cast("double")).alias("gold_words"), mean(~is_gold, F.col("shared").cast("double")).alias("other_words"),
    )


def is_soft(probs: Column, below: float = 0.999) -> Column:
    return F.array_max(probs) < below


def one_hot(probs: Column) -> Column:
    return (F.abs(F.array_max(probs) - 1) < 1e-9) & (F.size(F.filter(probs, lambda v: F.abs(v) >= 1e-9)) == 1)


def gold_place(probs: Column) -> Column:
    return argmax(probs)


def gates(verified: DataFrame, overlap: DataFrame, bias: DataFrame, most_bias: float = 0.15) -> DataFrame:
    """One manifest row from the three audits and whether each passes."""
    v = verified.agg(F.sum("rows").alias("rows"), (F.sum(F.col("bad_gold_sum") + F.col("bad_arity") + F.col("leak") + F.col("forbidden_key") + F.col("empty_state") + F.col("dup_anywhere")) == 0).alias("verify_pass"))
    o = overlap.agg(F.sum("overlap").alias("overlap")).withColumn("leak_pass", F.col("overlap") == 0)
    b = bias.agg(F.max("deviation").alias("max_deviation")).withColumn("bias_pass", F.col("max_deviation") <= most_bias)
    return v.crossJoin(o).crossJoin(b)  # one row each
