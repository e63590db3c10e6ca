"""What exact set joins share: numbers dealt to buckets as packed strings, and one fixed order of elements with common ones last."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from decisia.llm.common import partitions


class Order:
    """The fixed order of shingles: listed ones last, by count; others by hash."""

    def __init__(self, listed: np.ndarray, counts: np.ndarray) -> None:
        at = np.argsort(listed)
        self.listed, self.count = listed[at], counts[at]
        self.place = np.argsort(np.lexsort((self.listed, self.count)))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.listed >> np.uint64(44)] = True

    def which(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of those of x that are listed, and their places in the list."""
        some = np.flatnonzero(self.maybe[x >> np.uint64(44)])
        if not len(some) or not len(self.listed):
            return some[:0], some[:0]
        at = np.minimum(np.searchsorted(self.listed, x[some]), len(self.listed) - 1)
        ok = self.listed[at] == x[some]
        return some[ok], at[ok]

    def first(self, x: np.ndarray, k: int) -> np.ndarray:
        """The first k of a sorted set."""
        some, at = self.which(x)
        if not len(some):
            return x[:k]
        rest = np.delete(x, some)
        return rest[:k] if len(rest) >= k else np.concatenate([rest, x[some[np.argsort(self.place[at])]][: k - len(rest)]])


def by_bucket(to: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket as one packed string."""
    order = np.argsort(to, kind="stable")
    to, columns = to[order].astype(np.int64), tuple(c[order] for c in columns)
    edges = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]]).tolist()
    for lo in range(0, len(edges) - 1, 64):
        some = list(zip(edges[lo : lo + 64], edges[lo + 1 : lo + 65], strict=False))
        yield pa.RecordBatch.from_arrays([pa.array([int(to[a]) for a, _ in some], pa.int64()), pa.array([b"".join(c[a:b].tobytes() for c in columns) for a, b in some], pa.binary())], names=["bucket", "packed"])


def of_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The packed strings of each bucket; rows come in the order of buckets."""
    now, blobs = None, []
    for batch in batches:
        for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != now and blobs:
                yield blobs
                blobs = []
            now = bucket
            blobs.append(packed.as_py())
    if blobs:
        yield blobs


def dealt(rows: DataFrame, deal) -> DataFrame:
    return rows.mapInArrow(deal, "bucket long, packed binary").repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket")
