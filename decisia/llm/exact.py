"""Exact dedup by two-pass Bloom filtering.

First pass: every task notes which cells of a Bloom filter the 64-bit hashes of its normalised texts fall into, once or more
often; the notes are added up block by block, so that a cell's bit says 2 and more. Second pass: a text all of whose cells hold 2
is possibly repeated; only those rows shuffle, narrow (id and digest), to be counted exactly, and the rest pass straight through as
groups of one.

Scale: one job builds the whole filter, at cells_per_row cells a row, so that the share of false alarms is the same at every size
(2.4 per cent). A filter up to max_filter_mb is broadcast, and rows are probed where they are. A larger one is cut by the hash into slices of that size: one exchange takes
each slice's bits and its rows (id and digest) to the tasks that probe them, bits first, rows as a stream (45 million rows a slice), in one job whatever their number; a slice
that a hot text makes larger than others goes to several tasks, each with a copy of its bits. Copies are counted by partial aggregation before any
shuffle; a row that repeats very often is unfolded by many tasks; the join that hands a group's result to its members is one that adaptive execution splits when a group is hot.

Cases: null counts as the empty text, and empty texts are equal to each other; white space runs count as one space; very long
texts are hashed where they are read and don't travel. Of equal rows with one doc_id, one is kept; a null doc_id loses to any
other. An empty table gives no rows. Columns beside the id and the text are passed through by drop_copies and may bear any names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decisia.llm.common import SPACE, partitions, text_of, written

BLOCK_CELLS, PROBES, HELD_CELLS = 1 << 18, 2, 4_000_000


def normalised(text_col: str = "text"):
    return F.regexp_replace(text_of(text_col), SPACE, " ")


def cells(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rows by probes: the cells of each hash in a filter of so many (a power of two)."""
    h = hashes.astype(np.uint64)
    with np.errstate(over="ignore"):
        step = h * np.uint64(0x9E3779B97F4A7C15)
        step ^= step >> np.uint64(29)
        step |= np.uint64(1)
        at = h[:, None] + step[:, None] * np.arange(1, PROBES + 1, dtype=np.uint64)[None, :]
    return ((at >> np.uint64(7)) & np.uint64(size - 1)).astype(np.int64)


def noted(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells met, and whether more than one row met them; rows by probes."""
    at = np.sort(at, axis=1)
    fresh = np.ones(at.shape, bool)
    fresh[:, 1:] = at[:, 1:] != at[:, :-1]  # a row counts once in a cell
    found, n = np.unique(at[fresh], return_counts=True)
    return found, n > 1


def repeated_cells(hashes: DataFrame, size: int, slices: int) -> DataFrame:
    """slice, block, bits: the cells of 2 and more. hashes: h, slice."""
    cells_in_block = min(size, BLOCK_CELLS)

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            found, more = noted(np.concatenate(held))
            held.clear()
            block = found // cells_in_block
            edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]]).tolist()
            once, twice, offset = [], [], (found % cells_in_block).astype("<u4")
            for a, b in zip(edges, edges[1:], strict=False):
                once.append(offset[a:b].tobytes())
                twice.append(offset[a:b][more[a:b]].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]]), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["block", "once", "twice"])

        size_held = 0
        for batch in batches:
            if batch.num_rows:
                held.append(cells(batch.column(0).to_numpy(), size) + batch.column(1).to_numpy().astype(np.int64)[:, None] * size)
                size_held += held[-1].size
                if size_held >= HELD_CELLS:
                    yield out()
                    size_held = 0
        if held:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(cells_in_block, bool), np.zeros(cells_in_block, bool)

        def out(block: int) -> pa.RecordBatch:
            bits = np.packbits(twice).tobytes()
            once[:], twice[:] = False, False
            return pa.RecordBatch.from_arrays([pa.array([block * cells_in_block // size], pa.int32()), pa.array([block % (size // cells_in_block)], pa.int64()), pa.array([bits], pa.binary())], names=["slice", "block", "bits"])

        now = None
        for batch in batches:
            for block, x, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now is not None and block != now:
                    yield out(now)
                now, x = block, np.frombuffer(x, "<u4")
                twice[x[once[x]]] = True
                twice[np.frombuffer(y, "<u4")] = True
                once[x] = True
        if now is not None:
            yield out(now)

    blocks = slices * size // cells_in_block
    built = hashes.select("h", "slice").mapInArrow(note, "block long, once binary, twice binary")
    return written(built.repartition(min(blocks, partitions(hashes.sparkSession)), "block").sortWithinPartitions("block").mapInArrow(add, "slice int, block long, bits binary"), "filter")


def filter_of(found: DataFrame, k: int, size: int) -> bytes:
    """A slice's part, on the driver."""
    step = min(size, BLOCK_CELLS) // 8
    bits = bytearray(size // 8)
    for row in found.where(F.col("slice") == k).select("block", "bits").toLocalIterator():
        bits[row["block"] * step : (row["block"] + 1) * step] = row["bits"]
    return bytes(bits)


def possibly_repeated(rows: DataFrame, bits: bytes) -> DataFrame:
    """The rows with a boolean column maybe; one broadcast of the filter."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            at = cells(batch.column(batch.num_columns - 1).to_numpy(), 8 * len(found))
            hit = ((found[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], names=[*batch.schema.names, "maybe"])

    return rows.mapInArrow(probe, T.StructType([*rows.schema.fields, T.StructField("maybe", T.BooleanType())]))


def probed_by_slice(rows: DataFrame, found: DataFrame, size: int, slices: int) -> DataFrame:
    """The same with a filter in slices: rows (doc_id, text_sha256, h, slice) meet the bits of their slice in a task. A slice of more than twice the common number of rows has several."""
    spark, step = rows.sparkSession, min(size, BLOCK_CELLS) // 8
    counts = rows.groupBy("slice").agg(F.count("*").alias("n"))
    common = (counts.agg(F.sum("n")).first()[0] or 0) / slices
    tasks = F.broadcast(counts.select("slice", F.ceil(F.col("n") / (2 * max(1.0, common))).cast("int").alias("tasks")))  # a row a slice
    head = ["slice", "salt", "block", "bits", "doc_id", "text_sha256", "h"]
    bits = found.join(tasks, "slice").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    bits = bits.withColumns({"doc_id": F.lit(None).cast("long"), "text_sha256": F.lit(None).cast("string"), "h": F.lit(None).cast("long")}).select(*head)
    salted = rows.join(tasks, "slice").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("tasks")).cast("int"))
    salted = salted.withColumns({"block": F.lit(None).cast("long"), "bits": F.lit(None).cast("binary")}).select(*head)
    dealt = bits.unionAll(salted).repartition(max(partitions(spark), slices), "slice", "salt").sortWithinPartitions("slice", "salt", F.col("block").asc_nulls_last())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros(size // 8, np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).is_null().to_numpy(zero_copy_only=False)])
            cut = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                if (place[0, a], place[1, a]) != now:
                    now = place[0, a], place[1, a]
                    held[:] = 0
                some = batch.slice(a, b - a)
                if not place[2, a]:
                    for block, packed in zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True):
                        held[block * step : (block + 1) * step] = np.frombuffer(packed, np.uint8)
                    continue
                at = cells(some.column(6).to_numpy(), size)
                hit = ((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
                yield pa.RecordBatch.from_arrays([some.column(4), some.column(5), pa.array(hit)], names=["doc_id", "text_sha256", "maybe"])

    return dealt.mapInArrow(probe, "doc_id long, text_sha256 string, maybe boolean")


#: Repeats of one row that are unfolded in one place.
UNFOLDED = 100_000


def unfolded(rows: DataFrame) -> DataFrame:
    """A row for each of n copies, with its number from 1 in copy."""
    few = rows.where(F.col("n") <= UNFOLDED).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    parts = rows.where(F.col("n") > UNFOLDED).withColumn("_lo", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(UNFOLDED).cast("long")))).repartition(partitions(rows.sparkSession))
    many = parts.withColumn("copy", F.explode(F.sequence("_lo", F.least(F.col("n"), F.col("_lo") + UNFOLDED - 1)))).drop("_lo")
    return few.unionByName(many)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells_per_row: int = 12, max_filter_mb: float = 64) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = max(1, docs.count())
    slices = math.ceil(rows * cells_per_row / (max_filter_mb * (1 << 23)))
    size = 1 << max(15 if slices == 1 else 3, math.ceil(math.log2(rows * cells_per_row / slices)))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(normalised(text_col), 256).alias("text_sha256")).withColumn("h", F.xxhash64("text_sha256"))
    hashed = written(narrow.withColumn("slice", F.pmod(F.shiftright("h", 40), F.lit(slices)).cast("int")), "hashes")
    found = repeated_cells(hashed, size, slices)
    marked = possibly_repeated(hashed.drop("slice"), filter_of(found, 0, size)) if slices == 1 else written(probed_by_slice(hashed, found, size, slices), "marked")
    alone = marked.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = written(marked.where("maybe").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n")), "some")
    # tables, so that the join below stands on two plain exchanges and adaptive execution can split a hot group
    first = written(some.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "first")
    members = unfolded(some.join(first, "text_sha256"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return alone.unionAll(members.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_mb: int = 64, **filters: int) -> DataFrame:
    """The documents that stay, with all their columns. Dropped ids are broadcast only if their number is within broadcast_mb, else joined."""
    groups = written(exact_groups(docs, id_col, text_col, **filters), "groups")
    row, sha = f"_id_{uuid.uuid4().hex}", f"_sha_{uuid.uuid4().hex}"  # no name that docs may have
    marked = docs.withColumn(row, F.col(id_col).cast("long")).withColumn(sha, F.sha2(normalised(text_col), 256))

    def joined(some: DataFrame, how: str) -> DataFrame:
        return marked.join(some, marked[row].eqNullSafe(some["doc_id"]) & (marked[sha] == some["text_sha256"]), how)

    lost = groups.where(~F.col("kept")).select("doc_id", "text_sha256").distinct()
    stay = joined(F.broadcast(lost) if lost.count() * 96 <= broadcast_mb << 20 else lost, "left_anti")
    again = groups.where("group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where("n > 1 and kept").select("doc_id", "text_sha256")
    if again.limit(1).count():  # rows repeated as a whole are both lost and kept: one of each comes back
        stay = stay.unionByName(joined(again, "left_semi").dropDuplicates([row, sha]))
    return stay.drop(row, sha)
