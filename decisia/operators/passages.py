"""Which documents hold which passages: runs of bytes looked up in a filter where documents are read, before anything is shuffled.

Of each passage one run of bytes is its anchor: as long as the greatest power of two within the passage, up to 64, and of its runs of that length the one
with the least hash, so that words that all documents have aren't what is looked for where a passage has others. A task hashes all runs of a document's bytes, for each length that
some anchor has (a run of twice the length is made of two), and looks them up in a filter of bits of bounded size. Only documents with a hit go on. Passages up to
broadcast_mb in all go to every task, and hits are searched there at once; more passages meet the hits' hashes in a join, and the documents of these pairs are
searched. No document is taken apart into rows, and no passage, however short, is compared with all documents unless they hold its run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST, FILTER_BITS, CHUNK_BYTES = 64, 1 << 28, 1 << 20

_random = np.random.Generator(np.random.PCG64(77))
BYTES = _random.integers(0, 1 << 63, 256, dtype=np.uint64)
STEPS = {1 << k: np.uint64(int(_random.integers(1, 1 << 62)) * 2 + 1) for k in range(7)}


def doubled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of 2 n bytes from those of n."""
    out = h[:-n] * STEPS[n]
    out ^= out >> np.uint64(31)
    out += h[n:]
    return out


def runs(data: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the lengths (powers of two) the hashes of all runs of so many bytes."""
    h, n = BYTES[data], 1
    while n <= max(lengths, default=0) and len(h):
        if n in lengths:
            yield n, h
        if len(h) <= n or n >= LONGEST:
            return
        h, n = doubled(h, n), 2 * n


def anchor(passage: bytes) -> tuple[int, int]:
    """Length and hash of the run that a passage is looked up by."""
    n = min(LONGEST, 1 << (len(passage).bit_length() - 1))
    (h,) = (h for k, h in runs(np.frombuffer(passage, np.uint8), [n]) if k == n)
    return n, int(h.min())


def places(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & (bits - 1)


def anchored(passages: DataFrame) -> DataFrame:
    """passage, n, h: of each distinct passage that isn't empty, its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchor(p.as_py().encode()) for p in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int32()), pa.array(np.array([h for _, h in found], np.uint64).view(np.int64))], names=["passage", "n", "h"])

    return passages.where("passage <> ''").select("passage").distinct().mapInArrow(run, "passage string, n int, h long")


class Filter:
    """Lengths of anchors, and a bit for the hash of each."""

    def __init__(self, anchors: DataFrame, count: int) -> None:
        self.bits = min(FILTER_BITS, max(1 << 12, 1 << (64 * count).bit_length()))
        self.held, lengths = np.zeros(self.bits >> 3, np.uint8), set()
        for row in anchors.select("n", "h").toLocalIterator():  # numbers only, a part at a time, into a filter of fixed size
            at = int(places(np.array([row["h"]], np.int64).view(np.uint64), self.bits)[0])
            self.held[at >> 3] |= 1 << (at & 7)
            lengths.add(row["n"])
        self.lengths = sorted(lengths)

    def hits(self, texts: list[bytes]) -> list[set[tuple[int, int]]]:
        """Length and hash of the runs of each text that the filter knows."""
        found: list[set] = [set() for _ in texts]
        lo = 0
        while lo < len(texts):
            hi, size = lo + 1, len(texts[lo])
            while hi < len(texts) and size + len(texts[hi]) <= CHUNK_BYTES:
                size += len(texts[hi])
                hi += 1
            ends = np.cumsum([len(t) for t in texts[lo:hi]])
            whole = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
            for first in range(0, len(whole), CHUNK_BYTES):  # a long text in blocks that overlap by a run
                for n, h in runs(whole[first : first + CHUNK_BYTES + LONGEST - 1], self.lengths):
                    at = places(h, self.bits)
                    some = np.flatnonzero((self.held[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                    of = np.searchsorted(ends, some + first, side="right")
                    inside = some + first + n <= ends[of]
                    for i, x in set(zip(of[inside].tolist(), h[some[inside]].tolist(), strict=True)):
                        found[lo + i].add((n, x))
            lo = hi
        return found


def contained(docs: DataFrame, id_col: str, text: str, passages: DataFrame, passage_id: str, passage: str, broadcast_mb: int = 64) -> DataFrame:
    """id_col, passage_id: which documents hold which passages, both in normal form (single spaces). Null texts hold nothing, and an empty passage is in every text."""
    given = passages.select(F.col(passage_id), F.col(passage).alias("passage")).where("passage is not null")
    anchors = anchored(given)
    size = given.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("passage") + 64), F.lit(0)).alias("bytes")).first()
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(Filter(anchors, size["n"]))
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("passage", T.StringType())])
    rows = docs.where(F.col(text).isNotNull()).select(id_col, text)
    if size["bytes"] <= broadcast_mb << 20:
        by_run: dict[tuple[int, int], list[bytes]] = {}
        for row in anchors.collect():  # within broadcast_mb
            by_run.setdefault((row["n"], row["h"] % (1 << 64)), []).append(row["passage"].encode())
        sent = spark.sparkContext.broadcast(by_run)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, at, held = [t.as_py().encode() for t in batch.column(1)], [], []
                for i, hits in enumerate(known.value.hits(texts)):
                    for p in (p for hit in hits for p in sent.value.get(hit, ()) if p in texts[i]):
                        at.append(i)
                        held.append(p.decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(held, pa.string())], names=[id_col, "passage"])

        found = rows.mapInArrow(search, out)
        named = found.join(F.broadcast(given), "passage").select(id_col, passage_id)
    else:

        def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(i, n, h) for i, hits in enumerate(known.value.hits([t.as_py().encode() for t in batch.column(1)])) for n, h in hits]
                at, n, h = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
                columns = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(n, pa.int32()), pa.array(np.array(h, np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n", "h"])

        hit = rows.mapInArrow(hashes, T.StructType([out[0], T.StructField("n", T.IntegerType()), T.StructField("h", T.LongType())]))
        pairs = hit.join(anchors, ["n", "h"]).select(id_col, "passage")
        named = pairs.join(rows, id_col).where(F.contains(text, "passage")).select(id_col, "passage").join(given, "passage").select(id_col, passage_id)
    empty = given.where("passage = ''").select(passage_id).distinct()
    if empty.limit(1).count():
        named = named.unionByName(rows.select(id_col).crossJoin(F.broadcast(empty)))  # a row a passage that is empty
    return named.distinct()
