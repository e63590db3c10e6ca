"""How many elements of a set fall into each class: a mapping that shrinks the symmetric difference, so what it puts beyond the distance of a link is beyond it.

Long sets need more classes: by chance, two sets of n elements that share nothing differ by about 0.8 sqrt(2 n c) in c classes, and a link allows (100 - t) / (100 + t) 2 n, so with 64 classes any two
sets of 3,400 elements or more pass at 80 per cent. A class holds from four to eight elements here, up to MOST classes, so a set of 27,000 shingles is still told from any other. Classes are taken from the low
end of the same bits, so a sketch of more classes folds to one of fewer. Counts end at LIMIT; where one does, nothing is excluded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST, IN_CLASS, LIMIT = 64, 4096, 8, 255


def sketch(x: np.ndarray) -> bytes:
    """A byte a class."""
    classes = LEAST
    while classes < MOST and IN_CLASS * classes < len(x):
        classes *= 2
    return np.minimum(np.bincount((x >> np.uint64(20)).astype(np.int64) & (classes - 1), minlength=classes), LIMIT).astype(np.uint8).tobytes()


def may_link(x: np.ndarray, y: np.ndarray, per_cent: int) -> np.ndarray:
    """Row by row, of sketches of one width in x and one in y, whether a link isn't excluded; one row of x may stand for all."""
    whole = (x.max(axis=1) < LIMIT) & (y.max(axis=1) < LIMIT)
    width = min(x.shape[1], y.shape[1])
    x, y = (c.reshape(len(c), -1, width).sum(axis=1, dtype=np.int32) for c in (x, y))
    return ~whole | ((100 + per_cent) * np.abs(x - y).sum(axis=1) <= (100 - per_cent) * (x.sum(axis=1) + y.sum(axis=1)))


def near_enough(pairs: DataFrame, sketches: DataFrame, per_cent: int) -> DataFrame:
    """The pairs a, b that sketches don't exclude; sketches: sig, sketch."""
    both = pairs.join(sketches.select(F.col("sig").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("sig").alias("b"), F.col("sketch").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            kinds, of = np.unique(np.stack([pc.binary_length(batch.column(i)).to_numpy() for i in (2, 3)]), axis=1, return_inverse=True)
            for k in range(kinds.shape[1]):
                every = np.flatnonzero(of.reshape(-1) == k)
                for lo in range(0, len(every), 1024):
                    at = every[lo : lo + 1024]
                    ok[at] = may_link(*(np.frombuffer(b"".join(batch.column(i).take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1) for i in (2, 3)), per_cent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(run, "a long, b long")
