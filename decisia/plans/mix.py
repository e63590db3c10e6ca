"""The mix: many sources to one table of valid, distinct, clean decision rows, with its accounting and its gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisia.functions import text
from decisia.operators import audit, dedup
from decisia.operators.normalize import normalised
from decisia.sources import files
from decisia.sources.shared import durable


def mixed(rows: DataFrame, held_out: DataFrame, *order: str) -> DataFrame:
    """Valid rows in one form, the first of each state in the order, none of the held-out states. Adds key."""
    valid = normalised(rows).where("reason is null").withColumn("key", text.key_of(F.col("norm"), 64))
    fresh = dedup.not_in(valid.withColumn("short", F.substring("key", 1, 16)), held_out.select(F.col("key").alias("short")), "short").drop("short")
    return dedup.first_wins(fresh, "key", *order)


def outcomes(rows: DataFrame, held_out: DataFrame, *order: str) -> DataFrame:
    """Every row with what became of it: kept, held_out, duplicate_state, or why it isn't valid."""
    checked = normalised(rows).withColumn("key", text.key_of(F.col("norm"), 64))
    hit = held_out.select(F.col("key").alias("_h")).distinct()
    marked = checked.join(hit, F.substring("key", 1, 16) == F.col("_h"), "left")
    marked = marked.withColumn("reason", F.coalesce("reason", F.when(F.col("_h").isNotNull(), "held_out"))).drop("_h")
    first = marked.where("reason is null").groupBy("key").agg(F.min(F.struct(*order)).alias("_first"))
    out = marked.join(first, "key", "left")
    repeated = F.col("reason").isNull() & (F.struct(*order) != F.col("_first"))
    return out.withColumn("reason", F.when(repeated, "duplicate_state").otherwise(F.coalesce("reason", F.lit("kept")))).drop("_first")


def build(spark: SparkSession, rows: DataFrame, held_out: DataFrame, path: str, *order: str, force: bool = False) -> dict:
    """Writes the mix and its sidecar of counts; returns them. Done already if the rows are those that the sidecar says."""
    sidecar = f"{path}.stats.json"
    if files.up_to_date(spark, path, sidecar, force):
        return files.read_sidecar(spark, sidecar)
    judged = durable(outcomes(rows, held_out, *order))
    kept = judged.where("reason = 'kept'")
    kept.select("guid", "workflow", "state", "questions", "gold", "qtype", "keys", "texts", "probs", "norm", "key").write.mode("overwrite").parquet(path)
    totals = {r["reason"]: r["count"] for r in judged.groupBy("reason").count().collect()}
    types = {r["qtype"]: r["count"] for r in kept.groupBy("qtype").count().collect()}
    return files.write_stats(spark, path, {"rows_in": sum(totals.values()), "outcomes": totals, "qtype": types})


def audited(mix: DataFrame, held_out: DataFrame, id_col: str = "guid") -> DataFrame:
    """The manifest row of a written mix."""
    keyed = mix.withColumn("short", F.substring("key", 1, 16))
    place = mix.where("qtype = 'choice'").select(audit.key_namespace(F.col("keys")).alias("ns"), F.size("keys").alias("k"), audit.gold_place(F.col("probs")).alias("pos"))
    overlap = dedup.overlap(keyed, "workflow", "short", held_out.select(F.col("key").alias("short")), id_col)
    return audit.gates(audit.verify(mix, "workflow", id_col), overlap, audit.position_bias(place, "ns", "k", "pos"))
