"""Queries on predictions: logits are the embeddings' components, the gold option their label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisia.functions.vectors import argmax, doubles, one_hot, softmax
from decisia.operators import metrics
from decisia.plans.registry import query
from decisia.session import table

K = 10


def predictions(spark, sf_dir) -> DataFrame:
    """vec_id, z (ten logits), p, gold, g (one-hot)."""
    z = F.transform(F.slice(doubles(F.col("embedding")), 1, K), lambda x: x * 8)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", z.alias("z"), (F.col("label") % K).cast("int").alias("gold"))
    return rows.withColumn("p", softmax(F.col("z"))).withColumn("g", one_hot(F.lit(K), F.col("gold")))


P = f"""z AS (SELECT vec_id, (label % {K})::INTEGER AS gold, list_transform(embedding[1:{K}], lambda x: x::DOUBLE * 8) AS z FROM embeddings),
    e AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z),
    s AS (SELECT *, list_sum(e) AS s FROM e),
    p AS (SELECT vec_id, gold, z, list_transform(e, lambda x: x / s) AS p FROM s)"""


@query("argmax_accuracy", f"WITH {P} SELECT round(avg((list_position(p, list_max(p)) - 1 = gold)::INTEGER), 6) AS accuracy, round(avg(p[gold + 1]), 6) AS soft_accuracy, count(*) AS decisions FROM p")
def argmax_accuracy(spark, sf_dir):
    return metrics.summary(predictions(spark, sf_dir), F.col("gold")).select("accuracy", "soft_accuracy", "decisions")


@query("skipped_predictions", "SELECT count(*) FILTER (WHERE vec_id % 5 <> 0) AS decisions, count(*) FILTER (WHERE vec_id % 5 = 0) AS skipped FROM embeddings")
def skipped_predictions(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("p", F.when(F.col("vec_id") % 5 != 0, F.col("p")))
    return metrics.summary(rows, F.col("gold")).select("decisions", "skipped")


@query("brier", f"WITH {P} SELECT round(avg(list_sum(list_transform(p, lambda x, i: pow(x - CASE WHEN i = gold + 1 THEN 1 ELSE 0 END, 2)))), 6) AS brier FROM p")
def brier(spark, sf_dir):
    return metrics.summary(predictions(spark, sf_dir), F.col("gold")).select("brier")


@query("row_ece", f"WITH {P}, b AS (SELECT vec_id, least(floor(p[i] * 10), 9) AS b, sum(p[i] - CASE WHEN i = gold + 1 THEN 1 ELSE 0 END) AS d FROM p, LATERAL (SELECT unnest(range(1, {K + 1})) AS i) GROUP BY vec_id, b) SELECT round(avg(e), 6) AS row_ece FROM (SELECT vec_id, sum(abs(d)) / {K} AS e FROM b GROUP BY vec_id)")
def row_ece(spark, sf_dir):
    return metrics.summary(predictions(spark, sf_dir), F.col("gold")).select("row_ece")


@query("top_label_ece", f"WITH {P}, r AS (SELECT list_max(p) AS c, (list_position(p, list_max(p)) - 1 = gold)::INTEGER AS a FROM p), b AS (SELECT least(floor(c * 10), 9) AS b, count(*) AS n, sum(c) AS c, sum(a) AS a FROM r GROUP BY 1) SELECT round(sum(abs(a - c)) / sum(n), 6) AS ece, sum(n)::BIGINT AS rows FROM b")
def top_label_ece(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return metrics.calibration(rows, F.array_max("p"), argmax(F.col("p")) == F.col("gold"))


@query("score_mae", f"WITH {P} SELECT round(avg(abs(list_position(p, list_max(p)) - 1 - gold)), 6) AS mae FROM p")
def score_mae(spark, sf_dir):
    return predictions(spark, sf_dir).agg(F.round(F.avg(F.abs(argmax(F.col("p")) - F.col("gold"))), 6).alias("mae"))


@query("noul_accuracy", f"WITH {P} SELECT gold % 2 AS type, round(avg(((p[1] + p[3] + p[5] + p[7] + p[9] < 0.5) = (gold % 2 = 1))::INTEGER), 6) AS accuracy, count(*) AS n FROM p GROUP BY gold % 2")
def noul_accuracy(spark, sf_dir):
    even = F.col("p")[0] + F.col("p")[2] + F.col("p")[4] + F.col("p")[6] + F.col("p")[8]
    rows = predictions(spark, sf_dir).withColumn("type", F.col("gold") % 2)
    return rows.groupBy("type").agg(F.round(F.avg(((even < 0.5) == (F.col("type") == 1)).cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


@query("tvd", f"WITH {P} SELECT round(avg(list_sum(list_transform(p, lambda x, i: abs(x - CASE WHEN i = gold + 1 THEN 1 ELSE 0 END))) / 2), 6) AS tvd FROM p")
def tvd(spark, sf_dir):
    return predictions(spark, sf_dir).agg(F.round(F.avg(metrics.variation(F.col("p"), F.col("g"))), 6).alias("tvd"))


@query("latency_pctl", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(median(value), 6) AS p50, round(avg(value), 6) AS mean, count(*) AS n, max(value) FILTER (WHERE i = floor(0.95::DOUBLE * (n - 1))) AS p95 FROM r GROUP BY event_type")
def latency_pctl(spark, sf_dir):
    return metrics.latency(table(spark, sf_dir, "events"), "value", "event_type").withColumn("p50", F.round("p50", 6))


@query("step_throughput", "SELECT user_id % 4 AS rank, count(*) AS steps, round(avg(value), 6) AS mean, round(count(*) / sum(value), 6) AS rate FROM events WHERE value > 0 GROUP BY 1")
def step_throughput(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value > 0").groupBy((F.col("user_id") % 4).alias("rank"))
    return rows.agg(F.count("*").alias("steps"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.count("*") / F.sum("value"), 6).alias("rate"))


AXES = "SELECT event_type, 50 + count(*) / 1000.0::DOUBLE AS intelligence, avg(value) / 1000 AS usd, 0.1::DOUBLE AS ece, 0.2::DOUBLE AS tvd, median(value) AS p50, max(value) AS p95, event_type = 'view' AS local FROM events GROUP BY event_type"


@query("axes_composite", f"WITH a AS ({AXES}), b AS (SELECT event_type, intelligence, 10 - 30 * log10(usd) AS cost, 50 * (1 - 2 * ece) + 50 * (1 - tvd) AS calibration, 80 - 10 * log10(CASE WHEN local THEN 2 * p50 + 0.15 ELSE p50 END) - 10 * log10(CASE WHEN local THEN 2 * p95 + 0.15 ELSE p95 END) AS speed FROM a) SELECT event_type, round(cost, 6) AS cost, round(calibration, 6) AS calibration, round(speed, 6) AS speed, round(pow(intelligence * calibration * speed * cost, 0.25) * least(1, pow(intelligence / 50, 2)), 6) AS composite FROM b")
def axes_composite(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg((50 + F.count("*") / 1000.0).alias("intelligence"), (F.avg("value") / 1000).alias("usd"), F.percentile("value", F.lit(0.5)).alias("p50"), F.max("value").alias("p95"))
    made = metrics.axes(e.withColumn("ece", F.lit(0.1)).withColumn("tvd", F.lit(0.2)).withColumn("local", F.col("event_type") == "view"))
    return made.select("event_type", *(F.round(c, 6).alias(c) for c in ("cost", "calibration", "speed", "composite")))


@query("intelligence_tiers", "SELECT lang, round(27.15775 * a + 56.91075 * b + greatest(0, 62.7925 * (c - 0.33644)) - 25.7351, 6) AS intelligence FROM (SELECT lang, avg((doc_id % 2 = 0)::INTEGER) AS a, avg((doc_id % 3 = 0)::INTEGER) AS b, avg((doc_id % 5 < 3)::INTEGER) AS c FROM documents GROUP BY lang)")
def intelligence_tiers(spark, sf_dir):
    share = lambda c: F.avg(c.cast("double"))
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(share(i % 2 == 0).alias("a"), share(i % 3 == 0).alias("b"), share(i % 5 < 3).alias("c"))
    return rows.select("lang", F.round(metrics.intelligence(F.col("a"), F.col("b"), F.col("c")), 6).alias("intelligence"))


RPS = f"list_sum(list_transform(range(1, {K + 1}), lambda i: pow(list_sum(p[1:i]) - CASE WHEN i >= gold + 1 THEN 1 ELSE 0 END, 2))) / {K - 1}"


@query("proper_reward", f"WITH {P} SELECT gold % 2 AS is_score, round(avg(greatest(ln(greatest(p[gold + 1], 1e-12)), -9.21) + 0.75 * p[gold + 1] / greatest(sqrt(list_sum(list_transform(p, lambda x: x * x))), 1e-9) - CASE WHEN gold % 2 = 1 THEN {RPS} ELSE 0 END), 6) AS reward FROM p GROUP BY 1")
def proper_reward(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("is_score", F.col("gold") % 2)
    return rows.groupBy("is_score").agg(F.round(F.avg(metrics.proper_score(F.col("p"), F.col("g"), F.col("is_score") == 1)), 6).alias("reward"))


@query("group_advantage", "SELECT event_id, round((value - avg(value) OVER w) / (coalesce(stddev_samp(value) OVER w, 0) + 1e-6), 5) AS advantage FROM events WINDOW w AS (PARTITION BY event_id // 8)")
def group_advantage(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("grp", F.floor(F.col("event_id") / 8))
    return metrics.advantage(rows, "value", "grp").select("event_id", F.round("advantage", 5).alias("advantage"))


@query("soft_ce", f"WITH {P} SELECT round(avg(-(z[gold + 1] - ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) - list_max(z))), 6) AS loss FROM p")
def soft_ce(spark, sf_dir):
    return predictions(spark, sf_dir).agg(F.round(F.avg(metrics.soft_cross_entropy(F.col("z"), F.col("g"))), 6).alias("loss"))


GRID = [0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 10.0]


@query("temperature_grid", f"WITH {P}, t AS (SELECT gold % 3 AS qtype, t, avg(-(z[gold + 1] / t - ln(list_sum(list_transform(z, lambda x: exp(x / t - list_max(z) / t)))) - list_max(z) / t)) AS loss, count(*) AS n FROM p, (VALUES {', '.join(f'({t}::DOUBLE)' for t in GRID)}) v(t) GROUP BY ALL) SELECT qtype, max(n) AS rows, CASE WHEN max(n) < 10 THEN 1.0::DOUBLE ELSE arg_min(t, (round(loss, 9), t)) END AS temperature FROM t GROUP BY qtype")
def temperature_grid(spark, sf_dir):
    return metrics.temperatures(predictions(spark, sf_dir).withColumn("qtype", F.col("gold") % 3), "qtype", GRID)


@query("logit_spread", f"WITH {P} SELECT round(avg(list_max(z) - list_min(z)), 6) AS spread FROM p")
def logit_spread(spark, sf_dir):
    return metrics.spread(predictions(spark, sf_dir), "z")


@query("decision_features", f"WITH {P}, q AS (SELECT vec_id, list_reverse_sort(p) AS b, p FROM p) SELECT vec_id, round(b[1], 6) AS p1, round(b[1] - b[2], 6) AS lead, round(-list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-9)))) / ln({K}), 6) AS entropy, round({K} / 255.0::DOUBLE, 6) AS options FROM q")
def decision_features(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("vec_id", *metrics.features(F.col("p")))
    return rows.select("vec_id", *(F.round(c, 6).alias(c) for c in ("p1", "lead", "entropy", "options")))


@query("vector_stats", """WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_reverse(embedding)::DOUBLE[] AS b FROM embeddings), d AS (SELECT vec_id, a, b, list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i])) AS d, list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * b[i])) AS ab, list_sum(list_transform(a, lambda x: x * x)) AS aa FROM a)
    SELECT vec_id, round(ab / aa, 5) AS cosine, round(list_max(d), 6) AS max_diff, round(list_avg(d), 5) AS mean_diff, round(list_max(list_transform(b, lambda x: abs(x))), 6) AS abs_max, round(list_max(d) / list_max(list_transform(b, lambda x: abs(x))), 5) AS relative FROM d""")
def vector_stats(spark, sf_dir):
    a = doubles(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", *metrics.compared(a, F.reverse(a)))
    return rows.select("vec_id", *(F.round(c, 5 if c in ("cosine", "mean_diff", "relative") else 6).alias(c) for c in ("cosine", "max_diff", "mean_diff", "abs_max", "relative")))


@query("tier_accuracy", "SELECT r_name AS tier, count(*) AS n, round(avg((c_acctbal > 4000)::INTEGER), 6) AS accuracy FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name)")
def tier_accuracy(spark, sf_dir):
    tier = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("tier"))
    rows = table(spark, sf_dir, "customer").join(tier, F.col("c_nationkey") == F.col("n_nationkey"))
    return metrics.tiers(rows, "tier", F.col("c_acctbal") > 4000)


@query("cost_per_thousand", "SELECT lang, round(avg(n_chars) * 0.01 / 1000, 8) AS usd, count(*) FILTER (WHERE n_chars > 0) AS ok FROM documents GROUP BY lang")
def cost_per_thousand(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.avg("n_chars") * 0.01 / 1000, 8).alias("usd"), F.count_if(F.col("n_chars") > 0).alias("ok"))
