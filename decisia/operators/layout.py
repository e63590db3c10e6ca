"""Lengths and physical layout: percentiles, histograms, shards, length-bucketed batches, padding, integrity of training items."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decisia.functions import rand
from decisia.functions.once import once
from decisia.functions.vectors import total
from decisia.operators.sample import numbered
from decisia.sources.shared import durable

#: How the place of a quantile is found among n sorted values: half-even rounding, floor of n q, floor of (n - 1) q.
PLACES = {
    "nearest": lambda q, n: F.bround(q * (n - 1)),
    "floor_n": lambda q, n: F.least(F.floor(n * q), n - 1),
    "floor_last": lambda q, n: F.floor(q * (n - 1)),
}


#: Cells of values in which a place is looked for before any value is ranked.
VALUE_CELLS = 4096


def percentiles(df: DataFrame, value: str, quantiles: list[float], kind: str = "nearest", *group: str) -> DataFrame:
    """q, value: exact order statistics from counts of distinct values, so that the rows themselves are never sorted; nulls don't count.

    Over all rows, values are dealt into cells of equal width first, a row a cell tells in which a place lies, and only those cells are ranked.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    if group:
        by, near = W.partitionBy(*group), counts.withColumn("_before", F.lit(0)).withColumn("_total", F.sum("_n").over(W.partitionBy(*group)))
    else:
        counts = durable(counts)
        ends = counts.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"), F.sum("_n").alias("_total"))  # one row
        cell = F.least(F.lit(VALUE_CELLS - 1), F.floor((F.col(value) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300)) * VALUE_CELLS))
        dealt = counts.crossJoin(F.broadcast(ends)).withColumn("_cell", cell).drop("_lo", "_hi")
        cells = dealt.groupBy("_cell", "_total").agg(F.sum("_n").alias("_held")).withColumn("_before", F.sum("_held").over(W.partitionBy(F.lit(0)).orderBy("_cell")) - F.col("_held"))
        wanted = F.exists(F.array(*(PLACES[kind](F.lit(float(q)), F.col("_total")) for q in quantiles)), lambda at: (at >= F.col("_before")) & (at < F.col("_before") + F.col("_held")))
        by, near = W.partitionBy("_cell"), dealt.join(F.broadcast(cells.where(wanted).select("_cell", "_before")), "_cell")
    upto = near.withColumn("_upto", F.col("_before") + F.sum("_n").over(by.orderBy(value)))
    asked = upto.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in quantiles))))
    place = PLACES[kind](F.col("q"), F.col("_total"))
    return asked.where((place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_n"))).select(*group, "q", F.col(value).alias("value"))


def histogram(df: DataFrame, length: str, width: int = 32) -> DataFrame:
    """Both edges of each bin, so that a reader can't mistake one for the other."""
    low = (F.floor(F.col(length) / width) * width).cast("long")
    return df.groupBy(low.alias("bin_lo")).agg(F.count("*").alias("n")).select("bin_lo", (F.col("bin_lo") + width).alias("bin_hi"), "n")


def expanded(hist: DataFrame) -> DataFrame:
    """One length for each counted item, spread evenly in its bin and never past its end: the inverse of histogram."""
    span = F.col("bin_hi") - F.col("bin_lo")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    return hist.where("n > 0").select("bin_lo", "bin_hi", "n", k.alias("k")).select("bin_lo", F.least(F.col("bin_hi"), F.col("bin_lo") + F.floor(F.col("k") * span / F.col("n"))).cast("long").alias("length"))


def length_summary(df: DataFrame, length: str, thresholds: tuple[int, ...]) -> DataFrame:
    over = [F.count_if(F.col(length) > t).alias(f"over_{t}") for t in thresholds]
    return df.agg(F.count("*").alias("items"), F.sum(length).alias("tokens"), F.max(length).alias("longest"), F.round(F.avg(length), 6).alias("mean"), *over)


def buckets(df: DataFrame, length: str, edges: list[int]) -> DataFrame:
    """(lo, hi] buckets: items, real tokens and tokens padded to hi."""
    pairs = list(zip(edges, edges[1:], strict=False))
    bin_of = F.coalesce(*(F.when((F.col(length) > lo) & (F.col(length) <= hi), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))) for lo, hi in pairs))
    found = df.withColumn("_b", bin_of).where("_b is not null").groupBy("_b.lo", "_b.hi")
    return found.agg(F.count("*").alias("items"), F.sum(length).alias("real_tokens")).withColumn("padded_tokens", F.col("items") * F.col("hi"))


def row_shards(df: DataFrame, shards: int, *order: str) -> DataFrame:
    """Contiguous shards whose sizes differ by one at most, larger ones last."""
    rows = numbered(df, *order)
    n = df.agg(F.count("*").alias("_all"))
    return rows.crossJoin(F.broadcast(n)).withColumn("shard", F.floor(((F.col("row_number") + 1) * shards - 1) / F.col("_all")).cast("int")).drop("_all")


def token_shards(df: DataFrame, key: str, length: str, shards: int) -> DataFrame:
    """Equal-token shards: rows in the order of lengths are dealt back and forth, which keeps loads within the longest row of each turn."""
    rows = numbered(df.select(key, length), length, key)
    turn, at = F.floor(F.col("row_number") / shards), F.col("row_number") % shards
    return rows.withColumn("shard", F.when(turn % 2 == 0, at).otherwise(shards - 1 - at).cast("int")).drop("row_number")


def greedy_shards(df: DataFrame, key: str, length: str, shards: int) -> DataFrame:
    """Each row, in the order of lengths and keys, to the lightest shard, ties to the lowest: the walk over all rows, without walking them.

    Lengths rise, so a shard that gets a row is the heaviest from then on: the loads of any two never differ by more than the length that is dealt, and the one that was
    dealt to longest ago is lightest, strictly so by the first of its rows. Rows of some length therefore go round all shards in turn; rows without any length change no load and
    all go to the first.
    """
    rows = numbered(df.select(key, F.col(length).cast("long").alias(length)), length, key)
    none = df.agg(F.count_if(F.col(length) <= 0).alias("_none"))  # one row; rows without length come first
    shard = F.when(F.col(length) <= 0, 0).otherwise((F.col("row_number") - F.col("_none")) % shards).cast("int")
    return rows.crossJoin(F.broadcast(none)).select(key, length, shard.alias("shard"))


def random_batches(df: DataFrame, key: str, length: str, size: int, seed: int = 7) -> DataFrame:
    """Batches of a fixed size over a shuffle."""
    rows = numbered(df.select(key, length).withColumn("_o", rand.order_key(F.col(key), seed)), "_o", key)
    return rows.select(key, length, F.floor(F.col("row_number") / size).cast("long").alias("batch"))


def length_batches(df: DataFrame, key: str, length: str, size: int, budget: int | None, multiple: int = 64, seed: int = 7) -> DataFrame:
    """Length-bucketed batches under a token budget: key, length, bucket, batch.

    Rows in the order of lengths form buckets of size times multiple; in a bucket, in an order drawn from the seed, a batch is closed
    when it has size rows or when one more would pad it over the budget. The greedy walk is one fold over each bucket's array, whose
    length that product bounds, and notes where batches start; buckets are independent.
    """
    rows = numbered(df.select(key, F.col(length).cast("long").alias(length)), length, key).withColumn("bucket", F.floor(F.col("row_number") / (size * multiple)).cast("long"))
    each = rows.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct(rand.order_key(F.col(key), seed).alias("o"), F.col(key).alias("k"), F.col(length).alias("n")))).alias("xs"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("longest"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        longest = F.greatest(acc["longest"], x["n"])
        full = (acc["i"] == 0) | (acc["n"] >= size)
        if budget:
            full = full | (longest * (acc["n"] + 1) > budget)
        starts = F.when(full, F.array_append(acc["starts"], acc["i"])).otherwise(acc["starts"])  # an array grows by batches, not by rows
        return F.struct(F.when(full, 1).otherwise(acc["n"] + 1).alias("n"), F.when(full, x["n"]).otherwise(longest).alias("longest"), (acc["i"] + 1).alias("i"), starts.alias("starts"))

    walked = once(each, starts=F.aggregate("xs", start, step, lambda acc: acc["starts"]))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("xs")))
    batches = walked.select("bucket", "xs", F.posexplode(F.arrays_zip(F.col("starts").alias("a"), ends.alias("b"))).alias("batch", "z"))
    placed = batches.select("bucket", "batch", F.explode(F.slice("xs", F.col("z.a") + 1, F.col("z.b") - F.col("z.a"))).alias("x"))
    return placed.select(F.col("x.k").alias(key), F.col("x.n").alias(length), "bucket", "batch")


def shuffled_batches(plan: DataFrame, *batch: str, seed: int = 7) -> DataFrame:
    """Adds step: the batches' places in an order drawn from the seed, so that steps mix lengths. Only batches are sorted, not rows."""
    drawn = plan.select(*batch).distinct().withColumn("_o", rand.order_key(F.concat_ws("/", *(F.col(b).cast("string") for b in batch)), seed, "step"))
    steps = numbered(drawn, "_o", *batch).select(*batch, F.col("row_number").cast("long").alias("step"))
    return plan.join(steps, list(batch))


def epoch(df: DataFrame, key: str, length: str, size: int, budget: int | None, mode: str = "length", multiple: int = 64, seed: int = 0) -> DataFrame:
    """key, length, step of one epoch, another for each seed: length-bucketed batches under a token budget in a drawn order, or random ones."""
    if mode == "random":
        return random_batches(df, key, length, size, seed).withColumnRenamed("batch", "step")
    if mode != "length":
        raise ValueError(f"{mode} is no mode")
    return shuffled_batches(length_batches(df, key, length, size, budget, multiple, seed), "bucket", "batch", seed=seed).select(key, length, "step")


def strategies(df: DataFrame, key: str, length: str, size: int, budget: int, seeds: tuple[int, ...], multiple: int = 64) -> DataFrame:
    """Mean padded tokens of random and of bucketed batches over some seeds, and their ratio."""
    found = None
    for mode in ("random", "length"):
        for seed in seeds:
            b = epoch(df, key, length, size, budget, mode, multiple, seed).groupBy("step").agg((F.count("*") * F.max(length)).alias("padded"))
            one = b.agg(F.sum("padded").alias("padded")).withColumn("mode", F.lit(mode))
            found = one if found is None else found.unionByName(one)
    means = found.groupBy().agg(F.avg(F.when(F.col("mode") == "random", F.col("padded"))).alias("random_tokens"), F.avg(F.when(F.col("mode") == "length", F.col("padded"))).alias("bucketed_tokens"))
    return means.select("random_tokens", "bucketed_tokens", F.round(F.col("random_tokens") / F.col("bucketed_tokens"), 4).alias("ratio"))


def padded_markers(items: DataFrame, markers: str = "markers", least: int = 16, pad: int = 0) -> DataFrame:
    """Adds marker_pad and marker_mask, least places at least, so that shapes don't differ by the number of options."""
    room = F.greatest(F.lit(0), F.lit(least) - F.size(markers))
    return items.withColumn("marker_pad", F.concat(F.col(markers), F.array_repeat(F.lit(pad), room))).withColumn("marker_mask", F.concat(F.transform(markers, lambda _: F.lit(1)), F.array_repeat(F.lit(0), room)))


def batch_summary(plan: DataFrame, length: str, budget: int | None, *batch: str) -> DataFrame:
    """Tokens real and padded, waste, batches over the budget: avoidable ones, and single rows that nothing can help."""
    b = plan.groupBy(*batch).agg(F.count("*").alias("n"), F.max(length).alias("longest"), F.sum(length).alias("real"))
    padded = F.col("n") * F.col("longest")
    over = padded > budget if budget else F.lit(False)
    return b.agg(
        F.count("*").alias("batches"), F.sum("n").alias("items"), F.sum("real").alias("real_tokens"), F.sum(padded).alias("padded_tokens"),
        F.round(100 * (1 - F.sum("real") / F.sum(padded)), 4).alias("waste_percent"), F.max(padded).alias("max_padded"),
        F.count_if(over & (F.col("n") > 1)).alias("over_budget"), F.count_if(over & (F.col("n") == 1)).alias("single_over"),
    )


def quantised(plan: DataFrame, length: str, multiple: int, *batch: str) -> DataFrame:
    """Distinct padded shapes (rows, length) as they are and with lengths rounded up, and the cost in tokens."""
    b = plan.groupBy(*batch).agg(F.count("*").alias("n"), F.max(length).alias("longest"))
    up = (F.ceil(F.col("longest") / multiple) * multiple).cast("long")
    return b.withColumn("up", up).agg(F.count_distinct("longest").alias("shapes"), F.count_distinct("up").alias("quantised_shapes"), F.sum(F.col("n") * F.col("longest")).alias("padded"), F.sum(F.col("n") * F.col("up")).alias("quantised_padded"))


def collated(items: DataFrame, ids: str, pad: int, *batch: str) -> DataFrame:
    """Adds padded ids and mask, as long as the longest of the batch."""
    longest = F.max(F.size(ids)).over(W.partitionBy(*batch))
    room = longest - F.size(ids)
    return items.withColumn("padded", F.concat(F.col(ids), F.array_repeat(F.lit(pad), room))).withColumn("mask", F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), room)))


def integrity(items: DataFrame, most: int) -> DataFrame:
    """Counts of items whose markers, lengths or targets don't fit."""
    return items.agg(
        F.count("*").alias("items"), F.count_if(F.size("markers") != F.size("target")).alias("marker_target"), F.count_if(F.size("markers") == 0).alias("no_markers"),
        F.count_if(F.coalesce(F.array_max("markers") >= F.size("ids"), F.lit(False))).alias("marker_outside"), F.count_if(F.size("ids") > most).alias("too_long"), F.count_if(F.abs(total(F.col("target")) - 1) > 1e-6).alias("bad_target"),
    )


def hashed_words(c: Column) -> Column:
    """The tokenizer that needs no file: lower-cased words, each a digest's first 32 bits in 50,000 ids after the three special ones."""
    return F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"[^ \t\n\r\f]+"), 0), lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % 50000 + 3).cast("int"))


def training_items(rows: DataFrame, most: int = 4096, head: int = 256, tokenizer: Callable[[Column], Column] = hashed_words, marker: int = 1, separator: int = 2) -> DataFrame:
    """Decision rows in one form to items: ids, markers, qtype, target, label. tokenizer gives a text's ids as array<int>: an expression, or a
    vectorised function (pandas_udf) of a real tokenizer. Each option adds a marker before its ids. Rows whose markers don't fit in head are
    dropped, and long states are cut to most."""
    texts = F.transform(F.arrays_zip("keys", F.coalesce("texts", "keys").alias("texts")), lambda z: F.concat_ws(" ", z["keys"], z["texts"]))
    rows = once(rows, _texts=texts)
    each = once(rows, _state=tokenizer(F.col("norm")))
    if tokenizer is hashed_words:
        each = once(each, _options=F.transform("_texts", lambda t: F.concat(F.array(F.lit(marker)), tokenizer(t))))
    else:  # functions of Python take columns, not elements of arrays: options become rows and come back
        keyed = durable(each.withColumn("_key", F.monotonically_increasing_id()))  # a key of the row itself, since rows may be alike; as a table, so that it stays
        apart = keyed.select("_key", F.posexplode("_texts").alias("_i", "_t")).withColumn("_ids", F.concat(F.array(F.lit(marker)), tokenizer(F.col("_t"))))
        back = apart.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_ids"))), lambda x: x["_ids"]).alias("_options"))
        each = keyed.join(back, "_key").drop("_key")
    sizes = F.transform("_options", F.size)
    markers = F.transform(F.sequence(F.lit(0), F.size("_options") - 1), lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    made = once(each, head=F.flatten("_options"), markers=markers).where(F.size("head") <= head)
    ids = F.slice(F.concat("head", F.array(F.lit(separator)), F.col("_state")), 1, most)
    qtype = F.when(F.col("qtype") == "choice", 0).when(F.col("qtype") == "score", 1).otherwise(2).cast("tinyint")
    return made.select("guid", ids.alias("ids"), "markers", qtype.alias("qtype"), F.col("probs").alias("target"), (F.array_position("probs", F.array_max("probs")) - 1).cast("int").alias("label"))


#: Bins (low, high, weight) of drawn lengths where no histogram is given.
BINS = ((32, 64, 0.55), (128, 256, 0.30), (256, 512, 0.12), (512, 1024, 0.03))


def synthetic_items(spark, n: int, seed: int = 7, bins: tuple = BINS, tail: float = 0.005, longest: int = 4096) -> DataFrame:
    """Items of drawn lengths: a weighted bin and a place inside it, a small share in a long tail; without bins a bell curve around 256.
    bins may be a histogram (bin_lo, bin_hi, n). Each item has 2 to 6 options, as many markers, and a target that sums to one."""
    if isinstance(bins, DataFrame):
        bins = tuple((r["bin_lo"], r["bin_hi"], r["n"]) for r in bins.where("n > 0").orderBy("bin_lo").limit(10_000).collect())
    draw = lambda name: rand.uniform(F.col("id"), seed, name)
    u, v, w = draw("bin"), draw("place"), draw("tail")
    if bins:
        total_weight, upto, length = sum(b[2] for b in bins), 0.0, None
        for low, high, weight in bins:
            upto += weight / total_weight
            one = F.lit(low) + F.floor(v * (high - low))
            length = F.when(u < round(upto, 12), one) if length is None else length.when(u < round(upto, 12), one)
        length = length.otherwise(F.lit(bins[-1][0]) + F.floor(v * (bins[-1][1] - bins[-1][0])))
    else:
        bell = F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v)
        length = F.greatest(F.lit(8), F.least(F.lit(longest), F.floor(256 + 128 * bell)))
    length = F.when(w < tail, F.lit(longest // 2) + F.floor(v * (longest // 2))).otherwise(length).cast("long")
    options = (2 + F.floor(draw("k") * 5)).cast("int")
    rows = once(spark.range(n), length=length, options=options)
    step = F.greatest(F.lit(1), F.floor(F.col("length") / (F.col("options") * 2)))
    weights = F.transform(F.sequence(F.lit(0), F.col("options") - 1), lambda i: 1 + F.floor(rand.uniform(F.col("id"), seed, "target", i) * 9))
    rows = once(rows, markers=F.transform(F.sequence(F.lit(0), F.col("options") - 1), lambda i: (i * step).cast("int")), _w=F.transform(weights, lambda x: x.cast("double")))
    return rows.select(F.col("id").alias("item_id"), "length", "options", "markers", F.transform("_w", lambda x: x / total(F.col("_w"))).alias("target"))


def synthetic_batch(spark, rows: int, length: int, options: int = 4, vocabulary: int = 50_000, seed: int = 7) -> DataFrame:
    """row, ids, mask, markers of a seeded batch of one shape; row k has length - k real places at least one."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: (3 + F.floor(rand.uniform(F.col("id"), seed, "ids", i) * (vocabulary - 3))).cast("int"))
    real = F.greatest(F.lit(1), F.lit(length) - F.col("id")).cast("int")
    mask = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: (i < real).cast("int"))
    markers = F.transform(F.sequence(F.lit(0), F.lit(options - 1)), lambda i: F.floor(i * real / options).cast("int"))
    return spark.range(rows).select(F.col("id").alias("row"), ids.alias("ids"), mask.alias("mask"), markers.alias("markers"))


def synthetic_batches(plan: DataFrame, length: str, *batch: str, options: int = 4, vocabulary: int = 50_000, seed: int = 7) -> DataFrame:
    """Seeded batches of the shapes of a plan: for each of its batches as many rows, as long as its longest; row k has length - k real places, one at least.
    Gives the batch, row, ids, mask, markers."""
    shapes = plan.groupBy(*batch).agg(F.count("*").alias("_n"), F.max(length).cast("int").alias("_longest"))
    rows = shapes.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    rows = once(rows, _key=F.concat_ws("/", *(F.col(b).cast("string") for b in batch), F.col("row").cast("string")), _real=F.greatest(F.lit(1).cast("long"), F.col("_longest") - F.col("row")).cast("int"))
    places = F.sequence(F.lit(0), F.col("_longest") - 1)
    ids = F.transform(places, lambda i: (3 + F.floor(rand.uniform(F.col("_key"), seed, "ids", i) * (vocabulary - 3))).cast("int"))
    mask = F.transform(places, lambda i: (i < F.col("_real")).cast("int"))
    markers = F.transform(F.sequence(F.lit(0), F.lit(options - 1)), lambda i: F.floor(i * F.col("_real") / options).cast("int"))
    return rows.select(*batch, "row", ids.alias("ids"), mask.alias("mask"), markers.alias("markers"))
