"""A streaming face of scans, dedup and key tables: watermarks bound all state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from decisia.functions import rand


def stream(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet", files_a_trigger: int = 16) -> DataFrame:
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_a_trigger).load(path)


def first_seen(events: DataFrame, key: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return _timed(events, time, late).dropDuplicatesWithinWatermark([key])


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """Event time as an instant, with its watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed(events: DataFrame, value: str, kind: str, size: str = "1 hour", slide: str | None = None, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Counts and sums by time window and kind: tumbling, or sliding where slide is given."""
    spans = F.window(time, size, slide) if slide else F.window(time, size)
    return _timed(events, time, late).groupBy(spans.alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n", "total")


def sessions(events: DataFrame, user: str, gap: str = "30 minutes", time: str = "ts", late: str = "1 hour") -> DataFrame:
    return _timed(events, time, late).groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), user, "n")


def to_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Starts a query that keeps its result as a table: append adds what is final, by the sink's own commits; complete writes the whole result anew under the batch's number, so
    that a batch that comes again writes the same place, and drops those before the last."""
    if mode == "append":
        return rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{number}")
        replaced(df.sparkSession, path, number)

    return rows.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replaced(spark: SparkSession, path: str, number: int) -> None:
    """Drops the versions before the last two: the one before may be asked for by a batch that comes again."""
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{number - 2}")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def latest(spark: SparkSession, path: str) -> str | None:
    """The place of the last whole version under a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if fs.exists(p) else []
    return f"{path}/{max(found)}" if found else None


def reservoir(rows: DataFrame, key: str, k: int, path: str, weight: Column | None = None, seed: int = 7) -> DataStreamWriter:
    """A query that keeps the k rows of the greatest draws of all that came: with weights u^(1/w), else u. Draws are digests of keys, so after any batches it holds
    what the sample of all rows at once would. Its state is those k rows, a version a batch; each batch contributes k rows at most."""
    u = rand.uniform(F.col(key), seed)
    draw = u if weight is None else F.pow(u, F.lit(1.0) / weight)

    def batch(df: DataFrame, number: int) -> None:
        spark, kept = df.sparkSession, f"{path}/{number - 1}"
        best = lambda some: some.orderBy(F.col("draw").desc(), key).limit(k)
        new = best(df.withColumn("draw", draw))
        if number:
            new = best(new.unionByName(spark.read.schema(new.schema).parquet(kept)))
        new.write.mode("overwrite").parquet(f"{path}/{number}")
        replaced(spark, path, number)

    return rows.writeStream.foreachBatch(batch)


def grow_keys(rows: DataFrame, keys_path: str, accept: Callable[[DataFrame, int], None], key: str = "key", key_type: str = "string"):
    """A query that hands on rows whose keys the table lacks and then adds them: dedup against all that came before."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df = df.dropDuplicates([key])
        known = spark.read.schema(f"{key} {key_type}, batch long").parquet(keys_path).where(F.col("batch") < number)
        fresh = df.join(known.select(key), key, "left_anti")
        accept(fresh, number)
        fresh.select(key, F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(keys_path)

    return rows.writeStream.foreachBatch(batch)
