"""Shared plumbing of the training-data operators: tables, the shared folder, common expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every operator here: space and the ASCII controls 9 to 13 (also what bytes.split() uses).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a batch that goes to a Python worker: texts are long, and rows alone don't bound a batch.
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the cluster. Only where all runs on this machine (tests) may it be unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="decisia-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's file systems close."""
    path = f"{shared_dir(spark).rstrip('/')}/decisia-{uuid.uuid4().hex}/{name}"
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path).getParent()
    top.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(top)
    return path


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The frame as a table in the shared folder: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
