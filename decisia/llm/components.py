"""Connected components of links between long ids: to each id the least id that it is linked to.

Up to ONE_TASK links, which take a few megabytes, one task works them out. Beyond, labels are lowered by joins, with pointer
jumping, in rounds that are tables in the shared folder, so that no task holds a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisia.llm.common import written

ONE_TASK = 1_000_000


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order, and of each the least id of its component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (label[a], label[b]):  # roots hear of lower ones
            np.minimum.at(new, ends, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def components(links: DataFrame) -> DataFrame:
    """v, label: for each id in links (columns a and b), the least id that it is linked to, itself included."""
    edges = written(links.select("a", "b").where("a <> b"), "edges")
    return in_one_task(edges) if edges.count() <= ONE_TASK else by_rounds(edges)


def in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if pairs:
            ids, label = labelled(*(np.concatenate(c) for c in zip(*pairs, strict=True)))
            for lo in range(0, len(ids), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 100_000]), pa.array(label[lo : lo + 100_000])], names=["v", "label"])

    return written(edges.coalesce(1).mapInArrow(run, "v long, label long"), "labels")


def by_rounds(edges: DataFrame) -> DataFrame:
    edges = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("u", "v").alias("label")), "labels")
    while True:
        heard = edges.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("heard"))
        stepped = labels.join(heard, "v").select("v", "label", F.least("label", "heard").alias("next"))
        jump = labels.select(F.col("v").alias("next"), F.col("label").alias("far"))
        new = written(stepped.join(jump, "next").select("v", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("changed")), "labels")
        labels = new.select("v", "label")
        if not new.where("changed").limit(1).count():
            return labels
