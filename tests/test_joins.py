"""Range joins, passages inside documents, greedy walks and reservoirs over streams, against plain versions."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from decisia.functions import rand
from decisia.operators import layout, passages, sample
from decisia.streaming import events


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("most", [sample.MOST_RANGES, 0])
def test_ranges(spark, monkeypatch, seed, most):
    """Ranges of very unlike widths, empty ones, overlaps, points on edges and beyond; sent to tasks or joined."""
    monkeypatch.setattr(sample, "MOST_RANGES", most)
    r = random.Random(seed)
    ranges = [(i, a := r.choice([0.0, 1.0, r.uniform(-5, 5)]), a + r.choice([0.0, 1e-6, 0.5, 3.0, -1.0])) for i in range(40)] + [(99, -1000.0, 1000.0), (100, None, 2.0)]
    points = [(i, r.choice([0.0, 1.0, 1.5, r.uniform(-6, 6), 999.9, 1000.0, -1000.0])) for i in range(200)] + [(900, None)]
    made = sample.in_ranges(spark.createDataFrame(points, "p long, x double"), F.col("x"), spark.createDataFrame(ranges, "r long, lo double, hi double"), "lo", "hi")
    assert sorted((t["p"], t["r"]) for t in made.collect()) == sorted((p, k) for p, x in points for k, lo, hi in ranges if None not in (x, lo) and lo <= x < hi)
    assert "NestedLoop" not in plan_of(made) and made.columns == ["p", "x", "r", "lo", "hi"]


def test_ranges_without_any(spark):
    none = spark.createDataFrame([], "r long, lo double, hi double")
    assert sample.in_ranges(spark.createDataFrame([(1, 0.5)], "p long, x double"), F.col("x"), none, "lo", "hi").count() == 0


def test_draws_by_many_weights(spark):
    """A hundred thousand items, one of which has half of all the weight."""
    weights = spark.range(100_000).select(F.col("id").alias("item"), F.when(F.col("id") == 70_000, 100_000).otherwise(1).cast("long").alias("weight"))
    start = time.perf_counter()
    made = sample.weighted_choice(spark.range(200_000).withColumnRenamed("id", "draw"), "draw", weights)
    assert "NestedLoop" not in plan_of(made)
    n = {r["item"]: r["count"] for r in made.groupBy("item").count().collect()}
    assert sum(n.values()) == 200_000 and abs(n[70_000] - 100_000) < 2000 and time.perf_counter() - start < 120
    upto = sample.running(weights, "weight", "upto", "item").where("item in (0, 69999, 70000, 99999)").orderBy("item").collect()
    assert [r["upto"] for r in upto] == [1, 70_000, 170_000, 199_999]


def plain_contained(docs, items):
    return {(i, k) for i, t in docs if t is not None for k, p in items if p is not None and p in t}


@pytest.mark.parametrize("mb", [64, 0])
@pytest.mark.parametrize("bits", [passages.FILTER_BITS, 8])
def test_passages(spark, monkeypatch, mb, bits):
    """All lengths, one sign and none, glued ends, signs of several bytes, long texts; sent to tasks or joined; a filter that tells nothing."""
    monkeypatch.setattr(passages, "FILTER_BITS", bits)
    monkeypatch.setattr(passages, "CHUNK_BYTES", 97)
    r = random.Random(3)
    words = ["a", "of", "the", "straße", "日本", "quick", "x"]
    docs = [(i, " ".join(r.choices(words, k=r.choice([0, 1, 3, 20, 200])))) for i in range(60)] + [(90, None), (91, ""), (91, "of the"), (92, "théa" * 90)]
    whole = " ".join(t for _, t in docs if t)
    items = [(k, whole[a : a + n]) for k, (a, n) in enumerate((r.randrange(len(whole) - 300), r.choice([1, 2, 3, 7, 8, 31, 63, 64, 65, 130])) for _ in range(80))]
    items += [(200, "never there at all"), (201, None), (202, "of the"), (203, "of the"), (204, "théa" * 30)] + ([(205, "")] if mb else [])
    made = passages.contained(spark.createDataFrame(docs, "id long, t string"), "id", "t", spark.createDataFrame(items, "item long, b string"), "item", "b", broadcast_mb=mb)
    assert {tuple(x) for x in made.collect()} == plain_contained(docs, items)
    assert "Generate explode" not in plan_of(made)


def test_passages_of_common_words(spark):
    """Passages made of words that all documents have cost no more: their runs are looked up, not their words."""
    r = random.Random(1)
    text = lambda n: " ".join(r.choice(["the", "of", "and", "to"]) for _ in range(n))
    docs = [(i, text(200)) for i in range(2000)]
    items = [(k, docs[17 * k][1][40:140]) for k in range(40)] + [(100 + k, text(40)) for k in range(40)]
    frames = spark.createDataFrame(docs, "id long, t string"), spark.createDataFrame(items, "item long, b string")
    assert {tuple(x) for x in passages.contained(frames[0], "id", "t", frames[1], "item", "b").collect()} == plain_contained(docs, items)


def test_shards_of_many_lengths(spark):
    """A hundred thousand lengths and a thousand shards: nothing is worked out on the driver, and loads differ by the longest row at most."""
    rows = spark.range(100_000).select(F.col("id").alias("k"), (F.col("id") * 7919 % 100_003).alias("n"))
    loads = [x["s"] for x in layout.greedy_shards(rows, "k", "n", 1000).groupBy("shard").agg(F.sum("n").alias("s")).collect()]
    assert len(loads) == 1000 and max(loads) - min(loads) <= 100_003


def plain_batches(lengths, size, budget):
    out, n, longest, batch = [], 0, 0, -1
    for x in lengths:
        if batch < 0 or n >= size or budget and max(longest, x) * (n + 1) > budget:
            n, longest, batch = 0, 0, batch + 1
        n, longest = n + 1, max(longest, x)
        out.append(batch)
    return out


def test_batches_are_a_walk(spark):
    rows = [(i, 1 + i * i % 97) for i in range(300)]
    made = layout.length_batches(spark.createDataFrame(rows, "id long, n long"), "id", "n", 4, 150, multiple=20).collect()
    keys = {r["k"]: r["o"] for r in spark.createDataFrame([(i,) for i, _ in rows], "k long").select("k", rand.order_key(F.col("k"), 7).alias("o")).collect()}
    lengths = dict(rows)
    for bucket in {r["bucket"] for r in made}:
        of = sorted((keys[r["id"]], r["id"], r["batch"]) for r in made if r["bucket"] == bucket)
        assert [b for _, _, b in of] == plain_batches([lengths[i] for _, i, _ in of], 4, 150)
    assert sorted(r["id"] for r in made) == [i for i, _ in rows]


def test_a_large_bucket(spark):
    """65,536 rows in one bucket, eight a batch."""
    rows = spark.range(65_536).select(F.col("id").alias("k"), (F.col("id") % 50 + 1).alias("n"))
    start = time.perf_counter()
    made = layout.length_batches(rows, "k", "n", 8, None, multiple=8192)
    assert made.groupBy("bucket", "batch").count().agg(F.count("*").alias("n"), F.max("count").alias("m")).first().asDict() == {"n": 8192, "m": 8}
    assert time.perf_counter() - start < 60


def test_rows_that_are_alike_keep_their_options(spark):
    import pandas as pd

    @F.pandas_udf("array<int>")
    def letters(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [ord(c) for c in t])

    one = ("a", "choice", ["A", "B"], ["x", "yz"], [0.0, 1.0], "st")
    rows = spark.createDataFrame([one, one, ("a", "choice", ["A", "B"], ["other", "u"], [0.0, 1.0], "st")], "guid string, qtype string, keys array<string>, texts array<string>, probs array<double>, norm string")
    made = layout.training_items(rows, tokenizer=letters).collect()
    assert sorted(len(r["markers"]) for r in made) == [2, 2, 2] and sorted(len(r["ids"]) for r in made) == [12, 12, 15]


@pytest.mark.parametrize("files_a_trigger", [1, 3])
def test_reservoir_of_a_stream(spark, tmp_path, files_a_trigger):
    """However the stream is cut into batches, and stopped in between: the sample of all rows at once."""
    rows = spark.range(700).select("id", (F.col("id") % 5 + 1).cast("double").alias("w"))
    rows.repartition(6).write.parquet(f"{tmp_path}/in")
    weight = F.col("w")

    def run():
        source = events.stream(spark, f"{tmp_path}/in", rows.schema, files_a_trigger=files_a_trigger)
        q = events.reservoir(source, "id", 25, f"{tmp_path}/out", weight).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        return {r["id"] for r in spark.read.parquet(events.latest(spark, f"{tmp_path}/out")).collect()}

    assert run() == {r["id"] for r in sample.weighted_reservoir(rows, "id", weight, 25).collect()}
    more = spark.range(700, 1500).select("id", (F.col("id") % 5 + 1).cast("double").alias("w"))
    more.repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == {r["id"] for r in sample.weighted_reservoir(rows.unionAll(more), "id", weight, 25).collect()}


def test_keys_in_buckets_stay_where_they_are(spark, tmp_path):
    """An anti join deals rows to the keys' buckets and leaves the keys; another session reads them as buckets too."""
    from decisia.sources import files

    keys = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("key"))
    rows = spark.range(3000).select(F.col("id").cast("string").alias("key"), F.lit(1).alias("x"))
    path, before = f"{tmp_path}/keys", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for known in (files.bucketed_keys(spark, path, lambda: keys, buckets=4), files.bucketed_keys(spark, path, lambda: None), files.bucketed_keys(spark, path, lambda: None, "cached")):
            left = rows.join(known, "key", "left_anti")
            plan = plan_of(left)
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and left.count() == 2000 and known.count() == 1000
        spark.sql(f"DROP TABLE keys_{hashlib.md5(path.encode()).hexdigest()}")
        again = files.bucketed_keys(spark, path, lambda: None)  # as a session that hasn't made them
        assert again.count() == 1000 and "Bucketed: true" in plan_of(rows.join(again, "key", "left_anti"))
        assert files.bucketed_keys(spark, path, lambda: keys.limit(10), "rebuild", buckets=2).count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    with pytest.raises(FileNotFoundError):
        files.bucketed_keys(spark, f"{tmp_path}/none", lambda: keys, "cached")
    with pytest.raises(ValueError):
        files.bucketed_keys(spark, path, lambda: keys, "other")


def test_synthetic_batches_have_the_plans_shapes(spark):
    plan = spark.createDataFrame([(0, "a", 5), (0, "a", 9), (1, "a", 3), (1, "b", 1)], "k int, s string, n int")
    made = layout.synthetic_batches(plan, "n", "k", "s", options=2, vocabulary=100).collect()
    assert sorted((r["k"], r["s"], r["row"], len(r["ids"]), sum(r["mask"])) for r in made) == [(0, "a", 0, 9, 9), (0, "a", 1, 9, 8), (1, "a", 0, 3, 3), (1, "b", 0, 1, 1)]
    assert all(3 <= i < 100 for r in made for i in r["ids"]) and all(r["markers"] == [0, sum(r["mask"]) // 2] for r in made)
    assert made == layout.synthetic_batches(plan, "n", "k", "s", options=2, vocabulary=100).collect()
