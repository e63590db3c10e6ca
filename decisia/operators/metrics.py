"""Scores of predicted distributions: accuracy, proper scores, calibration, latency, axes, temperature. Predictions have arrays p and g."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decisia.functions.vectors import argmax, cumulative, dot, doubles, entropy, norm, softmax, total


def brier(p: Column, at: Column) -> Column:
    """Against the one-hot gold."""
    return total(F.transform(p, lambda x, i: (x - F.when(i == at, 1.0).otherwise(0.0)) * (x - F.when(i == at, 1.0).otherwise(0.0))))


def variation(p: Column, g: Column) -> Column:
    return total(F.zip_with(p, g, lambda x, y: F.abs(x - y))) / 2


def bins_of(confidence: Column, bins: int = 10) -> Column:
    return F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int")


def row_calibration(p: Column, at: Column, bins: int = 10) -> Column:
    """Expected calibration error of one row over its options: equal-width bins of p against being the gold one."""
    each = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.abs(total(F.transform(p, lambda x, i: F.when(bins_of(x, bins) == b, x - F.when(i == at, 1.0).otherwise(0.0)).otherwise(0.0)))))
    return total(each) / F.size(p)


def calibration(df: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error of the top label over all rows."""
    each = df.select(bins_of(confidence, bins).alias("b"), confidence.alias("c"), correct.cast("double").alias("a")).groupBy("b").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum("a").alias("a"))
    return each.agg(F.round(F.sum(F.abs(F.col("a") - F.col("c"))) / F.sum("n"), 6).alias("ece"), F.sum("n").alias("rows"))


def summary(df: DataFrame, at: Column) -> DataFrame:
    """Accuracy, soft accuracy, Brier score and calibration of choice predictions, and of rows without a prediction their number."""
    p = F.col("p")
    r = df.select(p, at.alias("at"), argmax(p).alias("top"))
    mean = lambda c: F.round(F.avg(c), 6)
    return r.agg(
        F.count("p").alias("decisions"), F.count_if(F.col("p").isNull()).alias("skipped"), mean((F.col("top") == F.col("at")).cast("double")).alias("accuracy"), mean(F.element_at("p", F.col("at") + 1)).alias("soft_accuracy"),
        mean(brier(p, F.col("at"))).alias("brier"), mean(row_calibration(p, F.col("at"))).alias("row_ece"),
    )


def proper_score(p: Column, g: Column, is_score: Column, spherical: float = 0.75, ranked: float = 1.0) -> Column:
    """Log score with a floor, and a share of the spherical score; for score questions less a share of the ranked probability score."""
    logs = F.transform(p, lambda x: F.greatest(F.ln(F.greatest(x, F.lit(1e-12))), F.lit(-9.21)))
    rps = total(F.zip_with(cumulative(p), cumulative(g), lambda a, b: (a - b) * (a - b))) / (F.greatest(F.size(p), F.lit(2)) - 1)
    return dot(g, logs) + spherical * dot(g, p) / F.greatest(norm(p), F.lit(1e-9)) - F.when(is_score, ranked * rps).otherwise(0.0)


def advantage(df: DataFrame, reward: str, *group: str) -> DataFrame:
    by = W.partitionBy(*group)
    return df.withColumn("advantage", (F.col(reward) - F.avg(reward).over(by)) / (F.coalesce(F.stddev_samp(reward).over(by), F.lit(0.0)) + 1e-6))


def soft_cross_entropy(logits: Column, g: Column, temperature: Column | float = 1.0) -> Column:
    z = F.transform(logits, lambda x: x / temperature)
    top = F.array_max(z)
    log_sum = F.ln(total(F.transform(z, lambda x: F.exp(x - top)))) + top
    return -total(F.zip_with(z, g, lambda x, y: y * (x - log_sum)))


def temperatures(df: DataFrame, group: str, grid: list[float], least: int = 10, bounds: tuple[float, float] = (0.1, 10.0)) -> DataFrame:
    """By group the temperature of the grid, kept within bounds, with the least mean soft cross-entropy; 1 for groups of few rows. The grid is the only copy made."""
    within = sorted({min(bounds[1], max(bounds[0], float(t))) for t in grid})
    each = df.withColumn("t", F.explode(F.array(*(F.lit(t) for t in within)))).withColumn("loss", soft_cross_entropy(F.col("z"), F.col("g"), F.col("t")))
    mean = each.groupBy(group, "t").agg(F.avg("loss").alias("loss"), F.count("*").alias("rows"))
    best = mean.groupBy(group).agg(F.min_by("t", F.struct(F.round("loss", 9), "t")).alias("best"), F.max("rows").alias("rows"))
    return best.select(group, "rows", F.when(F.col("rows") < least, 1.0).otherwise(F.col("best")).alias("temperature"))


def fitted_temperatures(df: DataFrame, group: str, least: int = 10, bounds: tuple[float, float] = (0.1, 10.0), rounds: int = 6, steps: int = 8) -> DataFrame:
    """The same without a grid of one's own: the loss falls and rises once in the temperature, so each round looks at a few steps between the
    neighbours of the last round's best, by group. A round is one pass over the rows; a row a group goes from one to the next."""
    here = df.select(group).distinct().select(group, F.lit(float(bounds[0])).alias("lo"), F.lit(float(bounds[1])).alias("hi"))
    best = None
    for _ in range(rounds):
        ratio = F.col("hi") / F.col("lo")
        grid = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.col("lo") * F.pow(ratio, k / F.lit(float(steps))))
        each = df.join(F.broadcast(here.select(group, F.explode(grid).alias("t"))), group).withColumn("loss", soft_cross_entropy(F.col("z"), F.col("g"), F.col("t")))
        mean = each.groupBy(group, "t").agg(F.avg("loss").alias("loss"), F.count("*").alias("rows"))
        best = [tuple(r) for r in mean.groupBy(group).agg(F.min_by("t", F.struct("loss", "t")).alias("t"), F.max("rows").alias("rows")).collect()]
        ends = {r[group]: (r["hi"] / r["lo"]) ** (1 / steps) for r in here.collect()}
        at = [(g, max(bounds[0], t / ends[g]), min(bounds[1], t * ends[g])) for g, t, _ in best]
        here = df.sparkSession.createDataFrame(at, f"{group} {dict(df.dtypes)[group]}, lo double, hi double")
    return df.sparkSession.createDataFrame([(g, n, 1.0 if n < least else t) for g, t, n in best], f"{group} {dict(df.dtypes)[group]}, rows long, temperature double")


def features(p: Column) -> list[Column]:
    """The top probability, its lead, normalised entropy, and the number of options over 255."""
    best = F.sort_array(p, asc=False)
    return [best[0].alias("p1"), (best[0] - best[1]).alias("lead"), (entropy(p) / F.ln(F.greatest(F.size(p), F.lit(2)))).alias("entropy"), (F.size(p) / 255.0).alias("options")]


def compared(a: Column, b: Column) -> list[Column]:
    """Cosine, greatest and mean absolute difference, greatest of b, and the first over the last."""
    far = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    most = F.array_max(F.transform(b, F.abs))
    return [(dot(a, b) / (norm(a) * norm(b))).alias("cosine"), F.array_max(far).alias("max_diff"), (total(far) / F.size(far)).alias("mean_diff"), most.alias("abs_max"), (F.array_max(far) / most).alias("relative")]


def axes(df: DataFrame) -> DataFrame:
    """From intelligence, usd (of a thousand), ece, tvd, p50, p95 and local: the axes and their composite."""
    seconds = lambda c: F.when(F.col("local"), 2 * F.col(c) + 0.15).otherwise(F.col(c))
    out = df.withColumn("cost", 10 - 30 * F.log10("usd")).withColumn("calibration", 50 * (1 - 2 * F.col("ece")) + 50 * (1 - F.col("tvd")))
    out = out.withColumn("speed", 80 - 10 * F.log10(seconds("p50")) - 10 * F.log10(seconds("p95")))
    product = F.col("intelligence") * F.col("calibration") * F.col("speed") * F.col("cost")
    return out.withColumn("composite", F.pow(product, F.lit(0.25)) * F.least(F.lit(1.0), F.pow(F.col("intelligence") / 50, F.lit(2.0))))


def intelligence(easy: Column, standard: Column, hard: Column) -> Column:
    # The published linear form of the three tiers.
    return 27.15775 * easy + 56.91075 * standard + F.greatest(F.lit(0.0), 62.7925 * (hard - 0.33644)) - 25.7351


def tiers(results: DataFrame, tier: str, correct: Column) -> DataFrame:
    """Accuracy by tier and over all (null tier)."""
    return results.rollup(tier).agg(F.count("*").alias("n"), F.round(F.avg(correct.cast("double")), 6).alias("accuracy"))


def latency(df: DataFrame, seconds: str, *group: str) -> DataFrame:
    """Exact median and 95th percentile by place."""
    from decisia.operators.layout import percentiles

    half = df.groupBy(*group).agg(F.percentile(seconds, F.lit(0.5)).alias("p50"), F.round(F.avg(seconds), 6).alias("mean"), F.count("*").alias("n"))
    late = percentiles(df, seconds, [0.95], "floor_last", *group).select(*group, F.col("value").alias("p95"))
    return half.join(late, list(group)) if group else half.crossJoin(late)


def logits_of(v: Column) -> Column:
    return doubles(v)


def prediction(v: Column) -> Column:
    return softmax(doubles(v))


def spread(df: DataFrame, logits: str) -> DataFrame:
    return df.where(F.size(logits) > 1).agg(F.round(F.avg(F.array_max(logits) - F.array_min(logits)), 6).alias("spread"))


def encoder_sizes(models: DataFrame, bytes_a_parameter: int = 4) -> DataFrame:
    """Adds parameters and bytes of encoders by their shape: vocabulary, hidden, inner, layers. Embeddings with a norm, and in each layer four
    projections with biases, two of the inner width and two norms."""
    h, i = F.col("hidden"), F.col("inner")
    embeddings = F.col("vocabulary") * h + 2 * h
    layer = 4 * (h * h + h) + (h * i + i) + (i * h + h) + 4 * h
    return models.withColumn("parameters", (embeddings + F.col("layers") * layer).cast("long")).withColumn("bytes", F.col("parameters") * bytes_a_parameter)


def inferred(rows: DataFrame, predict: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """The hook for a model: predict maps Arrow record batches of the rows to batches of schema, on executors; it loads its model once a task."""
    return rows.mapInArrow(predict, schema)
