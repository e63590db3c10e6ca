"""Queries on sampling, budgets, lengths, shards and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisia.functions import rand
from decisia.operators import layout, sample
from decisia.plans.registry import order_key, query, uniform
from decisia.session import table

QUANTILES = [0.5, 0.9, 0.99, 0.999]


def lengths(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").alias("length"))


@query("uniform_reservoir", f"SELECT doc_id, round({uniform('doc_id', 7)}, 9) AS u FROM documents ORDER BY {uniform('doc_id', 7)} DESC, doc_id LIMIT 100")
def uniform_reservoir(spark, sf_dir):
    return sample.reservoir(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100).select("doc_id", F.round("u", 9).alias("u"))


@query("ares_sample", f"SELECT doc_id FROM documents ORDER BY pow({uniform('doc_id', 7)}, 1.0::DOUBLE / CASE WHEN lang = 'en' THEN 1.0 ELSE 1.5 END::DOUBLE) DESC, doc_id LIMIT 100")
def ares_sample(spark, sf_dir):
    weight = F.when(F.col("lang") == "en", 1.0).otherwise(1.5)
    return sample.weighted_reservoir(table(spark, sf_dir, "documents"), "doc_id", weight, 100).select("doc_id")


@query("mix_budgets", f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {order_key('doc_id', 7)}, doc_id) AS r FROM documents) WHERE r <= 3 + replace(source, 'src', '')::BIGINT % 17")
def mix_budgets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    budgets = docs.select("source").distinct().withColumn("budget", 3 + F.replace("source", F.lit("src"), F.lit("")).cast("long") % 17)
    return sample.per_source(docs, "source", "doc_id", budgets)


@query("soft_cap", f"WITH d AS (SELECT doc_id, lang <> 'en' AS soft FROM documents) SELECT doc_id FROM d WHERE NOT soft UNION ALL SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {order_key('doc_id', 7)}, doc_id) AS r FROM d WHERE soft) WHERE r <= (SELECT floor(count(*) * 0.2) FROM d)")
def soft_cap(spark, sf_dir):
    return sample.soft_cap(table(spark, sf_dir, "documents").select("doc_id", "lang"), F.col("lang") != "en", "doc_id", 0.2).select("doc_id")


@query("soft_share", "SELECT count(*) FILTER (WHERE p BETWEEN 0.001 AND 0.999) AS soft, round(count(*) FILTER (WHERE p BETWEEN 0.001 AND 0.999) / count(*), 6) AS share FROM (SELECT CASE WHEN quality = 1 AND toxic = 1 THEN 0.85 ELSE quality END AS p FROM labels)")
def soft_share(spark, sf_dir):
    from decisia.operators.audit import is_soft

    p = F.when((F.col("quality") == 1) & (F.col("toxic") == 1), 0.85).otherwise(F.col("quality").cast("double"))
    soft = is_soft(F.array(1 - p, p))
    return table(spark, sf_dir, "labels").agg(F.count_if(soft).alias("soft"), F.round(F.avg(soft.cast("double")), 6).alias("share"))


@query("stride_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i FROM documents) WHERE i % 97 = 0")
def stride_sample(spark, sf_dir):
    return sample.strided(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 97, "n_chars", "doc_id").select("doc_id")


@query("mod_partition", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) WHERE i % 8 = 3")
def mod_partition(spark, sf_dir):
    return sample.rank_share(table(spark, sf_dir, "events").select("event_id", "ts"), 3, 8, "ts", "event_id").select("event_id")


@query("dense_ids", "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS row_number FROM events WHERE event_type <> 'view'")
def dense_ids(spark, sf_dir):
    return sample.numbered(table(spark, sf_dir, "events").where("event_type <> 'view'").select("event_id"), "event_id").select("event_id", F.col("row_number").cast("long").alias("row_number"))


@query("top_per_group", "SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INTEGER AS place FROM documents) WHERE place <= 3")
def top_per_group(spark, sf_dir):
    return sample.top_per_group(table(spark, sf_dir, "documents"), "source", [F.col("n_chars").desc(), F.col("doc_id")], 3).select("source", "doc_id", "place")


@query("target_limit", "SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 50")
def target_limit(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en'").orderBy("doc_id").limit(50).select("doc_id")


@query("shuffle_order", f"SELECT doc_id, {order_key('doc_id', 11)} AS o FROM documents")
def shuffle_order(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rand.order_key(F.col("doc_id"), 11).alias("o"))


@query("randint_draws", f"SELECT n, count(*) AS rows FROM (SELECT (3 + floor({uniform('event_id', 5)} * 4))::INTEGER AS n FROM events) GROUP BY n")
def randint_draws(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(rand.randint(F.col("event_id"), 3, 6, 5).alias("n")).agg(F.count("*").alias("rows"))


@query("sample_with_extremes", f"SELECT DISTINCT doc_id FROM (SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY {uniform('doc_id', 7)} DESC, doc_id LIMIT 40) UNION ALL SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 1) UNION ALL SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY n_chars, doc_id LIMIT 1))")
def sample_with_extremes(spark, sf_dir):
    return sample.with_extremes(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 40).select("doc_id")


@query("weighted_choice", f"WITH w AS (SELECT lang AS item, count(*) AS weight FROM documents GROUP BY lang), r AS (SELECT item, sum(weight) OVER (ORDER BY item) / sum(weight) OVER () AS hi, (sum(weight) OVER (ORDER BY item) - weight) / sum(weight) OVER () AS lo FROM w) SELECT item, count(*) AS n FROM events JOIN r ON {uniform('event_id', 7)} >= lo AND {uniform('event_id', 7)} < hi GROUP BY item")
def weighted_choice(spark, sf_dir):
    weights = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("item")).agg(F.count("*").alias("weight"))
    return sample.weighted_choice(table(spark, sf_dir, "events").select("event_id"), "event_id", weights).groupBy("item").agg(F.count("*").alias("n"))


@query("range_join", "WITH b AS (SELECT s_suppkey, s_acctbal AS lo, lead(s_acctbal) OVER (ORDER BY s_acctbal, s_suppkey) AS hi FROM supplier) SELECT s_suppkey, count(*) AS customers, min(c_custkey) AS first FROM customer JOIN b ON c_acctbal >= lo AND c_acctbal < hi GROUP BY s_suppkey")
def range_join(spark, sf_dir):
    """Customers by the two suppliers between whose balances theirs lies: bands as many as suppliers, as wide as it comes."""
    s = table(spark, sf_dir, "supplier")
    i = sample.numbered(s.select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey")
    bands = i.select("s_suppkey", F.col("s_acctbal").alias("lo"), "row_number").join(i.select(F.col("s_acctbal").alias("hi"), (F.col("row_number") - 1).alias("row_number")), "row_number").drop("row_number")
    met = sample.in_ranges(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal"), bands, "lo", "hi")
    return met.groupBy("s_suppkey").agg(F.count("*").alias("customers"), F.min("c_custkey").alias("first"))


@query("len_hist", "SELECT (n_chars // 32 * 32)::BIGINT AS bin_lo, (n_chars // 32 * 32 + 32)::BIGINT AS bin_hi, count(*) AS n FROM documents GROUP BY ALL")
def len_hist(spark, sf_dir):
    return layout.histogram(lengths(spark, sf_dir), "length")


@query("hist_expand", "WITH h AS (SELECT n_chars // 512 * 512 AS lo, count(*) AS n FROM documents GROUP BY 1) SELECT length, count(*) AS n FROM (SELECT least(lo + 512, lo + floor(k * 512 / n))::BIGINT AS length FROM (SELECT lo, n, unnest(range(n)) AS k FROM h)) GROUP BY length")
def hist_expand(spark, sf_dir):
    return layout.expanded(layout.histogram(lengths(spark, sf_dir), "length", 512)).groupBy("length").agg(F.count("*").alias("n"))


def _percentile_sql(place: str, of: str = "SELECT n_chars AS x FROM documents") -> str:
    qs = ", ".join(f"({q}::DOUBLE)" for q in QUANTILES)
    return f"WITH r AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM ({of})) SELECT q, x AS value FROM r, (VALUES {qs}) v(q) WHERE i = {place}"


@query("len_percentiles", _percentile_sql("round_even(q * (n - 1), 0)"))
def len_percentiles(spark, sf_dir):
    return layout.percentiles(lengths(spark, sf_dir), "length", QUANTILES)


@query("len_percentiles_floor", _percentile_sql("least(floor(n * q), n - 1)"))
def len_percentiles_floor(spark, sf_dir):
    return layout.percentiles(lengths(spark, sf_dir), "length", QUANTILES, "floor_n")


@query("len_percentiles_lines", _percentile_sql("floor(q * (n - 1))", "SELECT l_extendedprice AS x FROM lineitem"))
def len_percentiles_lines(spark, sf_dir):
    return layout.percentiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", QUANTILES, "floor_last")


@query("len_summary", "SELECT count(*) AS items, sum(n_chars)::BIGINT AS tokens, max(n_chars) AS longest, round(avg(n_chars), 6) AS mean, count(*) FILTER (WHERE n_chars > 2048) AS over_2048, count(*) FILTER (WHERE n_chars > 4096) AS over_4096 FROM documents")
def len_summary(spark, sf_dir):
    return layout.length_summary(lengths(spark, sf_dir), "length", (2048, 4096))


@query("len_by_shard", "SELECT source AS shard, count(*) AS items, sum(n_chars)::BIGINT AS tokens, round(avg(n_chars), 6) AS mean, max(n_chars) AS longest FROM documents GROUP BY source")
def len_by_shard(spark, sf_dir):
    return lengths(spark, sf_dir).groupBy(F.col("source").alias("shard")).agg(F.count("*").alias("items"), F.sum("length").alias("tokens"), F.round(F.avg("length"), 6).alias("mean"), F.max("length").alias("longest"))


@query("len_buckets", "SELECT lo::INTEGER AS lo, hi::INTEGER AS hi, count(*) AS items, sum(n_chars)::BIGINT AS real_tokens, (count(*) * hi)::BIGINT AS padded_tokens FROM documents, (VALUES (0, 512), (512, 1024), (1024, 2048), (2048, 8192)) b(lo, hi) WHERE n_chars > lo AND n_chars <= hi GROUP BY lo, hi")
def len_buckets(spark, sf_dir):
    return layout.buckets(lengths(spark, sf_dir), "length", [0, 512, 1024, 2048, 8192])


@query("long_subset", "SELECT doc_id, n_chars AS length FROM documents WHERE n_chars > 1024 AND n_chars <= 4096")
def long_subset(spark, sf_dir):
    return lengths(spark, sf_dir).where("length > 1024 AND length <= 4096").select("doc_id", "length")


@query("equal_row_shards", "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id)) * 7 - 1)::BIGINT // count(*) OVER () AS shard FROM documents")
def equal_row_shards(spark, sf_dir):
    return layout.row_shards(table(spark, sf_dir, "documents").select("doc_id"), 7, "doc_id").select("doc_id", F.col("shard").cast("long").alias("shard"))


@query("equal_token_shards", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i FROM documents) SELECT doc_id, CASE WHEN (i // 8) % 2 = 0 THEN i % 8 ELSE 7 - i % 8 END::INTEGER AS shard FROM r")
def equal_token_shards(spark, sf_dir):
    return layout.token_shards(lengths(spark, sf_dir), "doc_id", "length", 8).select("doc_id", "shard")


@query("greedy_token_shards", """WITH RECURSIVE r AS (SELECT doc_id, n_chars AS n, row_number() OVER (ORDER BY n_chars, doc_id) AS i FROM documents),
    w AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS doc_id, -1 AS shard, [0, 0, 0, 0, 0]::BIGINT[] AS loads
      UNION ALL SELECT r.i, r.doc_id, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda v, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN v + r.n ELSE v END) FROM w JOIN r ON r.i = w.i + 1)
    SELECT doc_id, shard::INTEGER AS shard FROM w WHERE i > 0""")
def greedy_token_shards(spark, sf_dir):
    return layout.greedy_shards(lengths(spark, sf_dir), "doc_id", "length", 5).select("doc_id", "shard")


@query("greedy_shard_loads", """WITH RECURSIVE r AS (SELECT doc_id, doc_id % 7 AS n, row_number() OVER (ORDER BY doc_id % 7, doc_id) AS i FROM documents),
    w AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS doc_id, -1 AS shard, [0, 0, 0, 0]::BIGINT[] AS loads
      UNION ALL SELECT r.i, r.doc_id, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda v, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN v + r.n ELSE v END) FROM w JOIN r ON r.i = w.i + 1)
    SELECT shard::INTEGER AS shard, count(*) AS items, sum(doc_id % 7)::BIGINT AS tokens, sum(doc_id)::BIGINT AS ids FROM w WHERE i > 0 GROUP BY shard""")
def greedy_shard_loads(spark, sf_dir):
    """Few lengths, many rows of each, and rows of no length: which shard gets which rows, and its load."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 7).alias("length"))
    return layout.greedy_shards(rows, "doc_id", "length", 4).groupBy("shard").agg(F.count("*").alias("items"), F.sum("length").alias("tokens"), F.sum("doc_id").alias("ids"))


@query("random_batches", f"SELECT doc_id, ((row_number() OVER (ORDER BY {order_key('doc_id', 7)}, doc_id) - 1) // 8)::BIGINT AS batch FROM documents")
def random_batches(spark, sf_dir):
    return layout.random_batches(lengths(spark, sf_dir), "doc_id", "length", 8).select("doc_id", "batch")


def _batches(size: int, budget: int, multiple: int, seed: int = 7, names: str = "o r w") -> str:
    """The greedy walk as a recursion over the places in each bucket."""
    o, r, w = names.split()
    return "WITH RECURSIVE " + f"""o AS (SELECT doc_id, n_chars AS n, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // {size * multiple} AS bucket FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {order_key('doc_id', seed)}, doc_id) AS i FROM o),
    w AS (SELECT bucket, i, doc_id, n, 1 AS m, n AS longest, 0 AS batch FROM r WHERE i = 1
      UNION ALL SELECT r.bucket, r.i, r.doc_id, r.n, CASE WHEN f THEN 1 ELSE m + 1 END, CASE WHEN f THEN r.n ELSE greatest(longest, r.n) END, CASE WHEN f THEN batch + 1 ELSE batch END
      FROM w JOIN r ON r.bucket = w.bucket AND r.i = w.i + 1, LATERAL (SELECT m >= {size} OR greatest(longest, r.n) * (m + 1) > {budget} AS f))""".replace("o AS (", f"{o} AS (").replace("FROM o)", f"FROM {o})").replace("r AS (SELECT *", f"{r} AS (SELECT *").replace("FROM r WHERE i = 1", f"FROM {r} r WHERE i = 1").replace("w AS (SELECT bucket", f"{w} AS (SELECT bucket").replace("FROM w JOIN r ON", f"FROM {w} w JOIN {r} r ON")


PLAN = _batches(8, 16384, 4)


@query("length_bucket_batches", f"{PLAN} SELECT doc_id, bucket::BIGINT AS bucket, batch::INTEGER AS batch FROM w")
def length_bucket_batches(spark, sf_dir):
    return layout.length_batches(lengths(spark, sf_dir), "doc_id", "length", 8, 16384, 4).select("doc_id", "bucket", "batch")


SUMMARY = "count(*) AS batches, sum(n)::BIGINT AS items, sum(r)::BIGINT AS real_tokens, sum(n * l)::BIGINT AS padded_tokens, round(100 * (1 - sum(r) / sum(n * l)), 4) AS waste_percent, max(n * l)::BIGINT AS max_padded, count(*) FILTER (WHERE n * l > 16384 AND n > 1) AS over_budget, count(*) FILTER (WHERE n * l > 16384 AND n = 1) AS single_over"


@query("batch_summary", f"{PLAN} SELECT {SUMMARY} FROM (SELECT count(*) AS n, max(n) AS l, sum(n) AS r FROM w GROUP BY bucket, batch)")
def batch_summary(spark, sf_dir):
    return layout.batch_summary(layout.length_batches(lengths(spark, sf_dir), "doc_id", "length", 8, 16384, 4), "length", 16384, "bucket", "batch")


@query("batch_compare", f"{PLAN}, x AS (SELECT n_chars AS n, (row_number() OVER (ORDER BY {order_key('doc_id', 7)}, doc_id) - 1) // 8 AS batch FROM documents), p AS (SELECT (SELECT sum(k) FROM (SELECT count(*) * max(n) AS k FROM x GROUP BY batch))::BIGINT AS random_tokens, (SELECT sum(k) FROM (SELECT count(*) * max(n) AS k FROM w GROUP BY bucket, batch))::BIGINT AS bucketed_tokens) SELECT random_tokens, bucketed_tokens, round(random_tokens / bucketed_tokens, 4) AS ratio FROM p")
def batch_compare(spark, sf_dir):
    rows = lengths(spark, sf_dir)
    one = layout.batch_summary(layout.random_batches(rows, "doc_id", "length", 8), "length", None, "batch").select(F.col("padded_tokens").alias("random_tokens"))
    two = layout.batch_summary(layout.length_batches(rows, "doc_id", "length", 8, 16384, 4), "length", 16384, "bucket", "batch").select(F.col("padded_tokens").alias("bucketed_tokens"))
    return one.crossJoin(two).withColumn("ratio", F.round(F.col("random_tokens") / F.col("bucketed_tokens"), 4))


STEP = order_key("bucket || '/' || batch", 7, "step")


@query("epoch_steps", f"{PLAN}, b AS (SELECT DISTINCT bucket, batch FROM w), s AS (SELECT bucket, batch, row_number() OVER (ORDER BY {STEP}, bucket, batch) - 1 AS step FROM b) SELECT doc_id, step FROM w JOIN s USING (bucket, batch)")
def epoch_steps(spark, sf_dir):
    """One epoch: bucketed batches in a drawn order."""
    return layout.epoch(lengths(spark, sf_dir), "doc_id", "length", 8, 16384, "length", 4, 7).select("doc_id", "step")


@query("epoch_random", f"SELECT doc_id, ((row_number() OVER (ORDER BY {order_key('doc_id', 3)}, doc_id) - 1) // 8)::BIGINT AS step FROM documents")
def epoch_random(spark, sf_dir):
    return layout.epoch(lengths(spark, sf_dir), "doc_id", "length", 8, None, "random", seed=3).select("doc_id", "step")


SEEDS = (1, 2, 3)
WALKS = ", ".join(_batches(8, 16384, 4, s, f"o{s} r{s} w{s}").removeprefix("WITH RECURSIVE ") for s in SEEDS)
RANDOM = " + ".join(f"(SELECT sum(k) FROM (SELECT count(*) * max(n) AS k FROM (SELECT n_chars AS n, (row_number() OVER (ORDER BY {order_key('doc_id', s)}, doc_id) - 1) // 8 AS batch FROM documents) GROUP BY batch))" for s in SEEDS)
BUCKETED = " + ".join(f"(SELECT sum(k) FROM (SELECT count(*) * max(n) AS k FROM w{s} GROUP BY bucket, batch))" for s in SEEDS)


@query("batch_strategies", f"WITH RECURSIVE {WALKS}, p AS (SELECT ({RANDOM})::DOUBLE / 3 AS a, ({BUCKETED})::DOUBLE / 3 AS b) SELECT a AS random_tokens, b AS bucketed_tokens, round(a / b, 4) AS ratio FROM p")
def batch_strategies(spark, sf_dir):
    """Both ways over three seeds."""
    return layout.strategies(lengths(spark, sf_dir), "doc_id", "length", 8, 16384, SEEDS, 4)


@query("shape_quantize", f"{PLAN} SELECT count(DISTINCT l) AS shapes, count(DISTINCT (l + 15) // 16 * 16) AS quantised_shapes, sum(n * l)::BIGINT AS padded, sum(n * ((l + 15) // 16 * 16))::BIGINT AS quantised_padded FROM (SELECT count(*) AS n, max(n) AS l FROM w GROUP BY bucket, batch)")
def shape_quantize(spark, sf_dir):
    return layout.quantised(layout.length_batches(lengths(spark, sf_dir), "doc_id", "length", 8, 16384, 4), "length", 16, "bucket", "batch")


@query("pad_collate", "WITH t AS (SELECT doc_id, list_transform(range(1 + doc_id % 7), lambda i: (doc_id + i) % 100) AS ids, doc_id // 8 AS batch FROM documents) SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(max(len(ids)) OVER (PARTITION BY batch) - len(ids)), lambda i: 0)), ',') AS padded, len(ids)::INTEGER AS real FROM t")
def pad_collate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ids = F.transform(F.sequence(F.lit(0), F.col("doc_id") % 7), lambda i: ((F.col("doc_id") + i) % 100).cast("int"))
    made = layout.collated(d.select("doc_id", ids.alias("ids"), F.floor(F.col("doc_id") / 8).alias("batch")), "ids", 0, "batch")
    return made.select("doc_id", F.array_join(F.col("padded").cast("array<string>"), ",").alias("padded"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("real"))


@query("item_integrity", "SELECT count(*) AS items, count(*) FILTER (WHERE doc_id % 5 = 0) AS marker_target, count(*) FILTER (WHERE doc_id % 7 = 0) AS no_markers, count(*) FILTER (WHERE doc_id % 7 <> 0 AND 1 + doc_id % 4 >= 1 + doc_id % 7 ) AS marker_outside, count(*) FILTER (WHERE 1 + doc_id % 7 > 5) AS too_long, count(*) FILTER (WHERE doc_id % 3 = 0 OR doc_id % 7 = 0 AND doc_id % 5 <> 0) AS bad_target FROM documents")
def item_integrity(spark, sf_dir):
    """An item without a target has a bad one."""
    i = F.col("doc_id")
    markers = F.when(i % 7 == 0, F.array().cast("array<int>")).otherwise(F.array((1 + i % 4).cast("int"), F.lit(0)))
    size = F.when(i % 7 == 0, 0).otherwise(2) + F.when(i % 5 == 0, 1).otherwise(0)
    target = F.transform(F.array_repeat(F.lit(1.0), size.cast("int")), lambda x: x / F.when(i % 3 == 0, 10).otherwise(size))
    rows = table(spark, sf_dir, "documents").select(F.transform(F.sequence(F.lit(0), i % 7), lambda x: x.cast("int")).alias("ids"), markers.alias("markers"), target.alias("target"))
    return layout.integrity(rows, 5)


def _draw(name: str, extra: str | None = None) -> str:
    return uniform("id", 7, name, *([extra] if extra else []))


LENGTH = f"""CASE WHEN {_draw('tail')} < 0.005 THEN 2048 + floor({_draw('place')} * 2048) WHEN {_draw('bin')} < 0.55 THEN 32 + floor({_draw('place')} * 32) WHEN {_draw('bin')} < 0.85 THEN 128 + floor({_draw('place')} * 128)
    WHEN {_draw('bin')} < 0.97 THEN 256 + floor({_draw('place')} * 256) ELSE 512 + floor({_draw('place')} * 512) END"""


@query("synth_items", f"""WITH i AS (SELECT id, ({LENGTH})::BIGINT AS length, (2 + floor({_draw('k')} * 5))::INTEGER AS options FROM range(2000) r(id)),
    t AS (SELECT *, list_transform(range(options), lambda i: 1 + floor({_draw('target', '=i')} * 9)) AS w FROM i)
    SELECT id AS item_id, length, options, array_to_string(list_transform(range(options), lambda i: i * greatest(1, length // (options * 2))), ',') AS markers, array_to_string(list_transform(w, lambda x: round(x / list_sum(w), 6)), ',') AS target FROM t""")
def synth_items(spark, sf_dir):
    made = layout.synthetic_items(spark, 2000)
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    return made.select("item_id", "length", "options", joined(F.col("markers")).alias("markers"), joined(F.transform("target", lambda x: F.round(x, 6))).alias("target"))


@query("synth_items_like", f"""WITH h AS (SELECT n_chars // 512 * 512 AS lo, count(*) AS n FROM documents GROUP BY 1), c AS (SELECT lo, (sum(n) OVER (ORDER BY lo) / sum(n) OVER ())::DOUBLE AS hi, ((sum(n) OVER (ORDER BY lo) - n) / sum(n) OVER ())::DOUBLE AS low FROM h)
    SELECT lo::BIGINT AS bin_lo, count(*) AS n FROM range(3000) r(id) JOIN c ON {_draw('bin')} >= round(low, 12) AND {_draw('bin')} < CASE WHEN hi >= 1 THEN 2 ELSE round(hi, 12) END WHERE {_draw('tail')} >= 0 GROUP BY lo""")
def synth_items_like(spark, sf_dir):
    """Lengths drawn like those of documents, from their histogram."""
    hist = layout.histogram(lengths(spark, sf_dir), "length", 512)
    made = layout.synthetic_items(spark, 3000, bins=hist, tail=0.0)
    return made.groupBy((F.floor(F.col("length") / 512) * 512).alias("bin_lo")).agg(F.count("*").alias("n"))


def _ids(text: str) -> str:
    return f"list_transform(regexp_extract_all(lower({text}), '[^ \\t\\n\\r\\f]+'), lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % 50000 + 3)"


def _items_sql() -> str:
    """Items of the kept rows: options by kind, each after a marker, then the state."""
    from decisia.plans.rows import OUTCOME, STATE_NORM

    options = "CASE doc_id % 24 WHEN 17 THEN ['false n', 'true y'] WHEN 18 THEN ['0 a', '1 b', '2 c'] ELSE ['A a', 'B b', 'C c'] END"
    return f"""WITH k AS (SELECT doc_id, {options} AS o, {STATE_NORM} AS state FROM documents WHERE {OUTCOME} = 'kept'),
    i AS (SELECT doc_id, len(o) AS n, list_concat(flatten(list_transform(o, lambda t: list_concat([1], {_ids('t')}))), [2], {_ids('state')})[1:4096] AS ids FROM k)
    SELECT doc_id::VARCHAR AS guid, len(ids)::INTEGER AS n, md5(array_to_string(ids, ',')) AS ids, array_to_string(list_transform(range(n), lambda j: 3 * j), ',') AS markers, CASE doc_id % 24 WHEN 17 THEN 2 WHEN 18 THEN 1 ELSE 0 END::TINYINT AS qtype, CASE WHEN doc_id % 24 IN (17, 18) THEN 1 ELSE 0 END::INTEGER AS label FROM i"""


@query("tokenized_items", _items_sql())
def tokenized_items(spark, sf_dir):
    from decisia.operators.normalize import normalised
    from decisia.plans.rows import test_rows

    items = layout.training_items(normalised(test_rows(spark, sf_dir)).where("reason is null"))
    return items.select("guid", F.size("ids").alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"), F.array_join(F.col("markers").cast("array<string>"), ",").alias("markers"), "qtype", "label")
