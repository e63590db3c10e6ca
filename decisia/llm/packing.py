"""Packing documents into windows of a fixed number of ids by the sum-of-squares rule.

A document's ids are cut into whole windows and a rest. Rests are placed online, as they come: of all fill levels that an
open window has (an empty one counts as a new window), the rest goes to the level after which the sum over levels of the
squared number of open windows is least; ties go to the fullest window. A level array holds the number of open windows at
each level. When a task's documents end, the emptiest open windows are cut to fill the fullest, and what remains of one
window becomes sequences whose lengths are powers of two, which need no padding: a task pads nothing.

No shuffle: each task packs the documents that it reads. Open windows are all that a task keeps. Cases: a null text is an
empty one, a single end id; a very long text fills whole windows as it comes, only its rest is placed; rows without or with a
repeated id are packed each; of levels that tie the fullest is taken; an empty table gives no rows; extra columns are left out.
A special token's string in a text becomes its id, or ordinary text with special=False.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisia.llm.common import text_of
from decisia.llm.encoding import encoder

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FAR = np.int64(1) << 60


class Packer:
    """Pieces are (doc_id, start, ids, doc_tokens); closed windows go to emit(pieces)."""

    def __init__(self, length: int, emit) -> None:
        self.length, self.emit = length, emit
        self.count = np.zeros(length + 1, np.int64)
        self.open: list[list] = [[] for _ in range(length + 1)]

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, L = len(ids), self.length
        whole = n - n % L
        for lo in range(0, whole, L):
            self.emit([(doc_id, lo, ids[lo : lo + L], n)])
        if whole < n:
            self.place((doc_id, whole, ids[whole:], n))

    def place(self, piece: tuple) -> None:
        size, count, L = len(piece[2]), self.count, self.length
        here = count[1 : L - size]
        change = np.where(here > 0, 2 * (count[size + 1 : L] - here) + 2, FAR)
        best, level = 2 * count[size] + 1, 0
        if len(change):
            at = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= best:
                best, level = change[at], at + 1
        if count[L - size] and 1 - 2 * count[L - size] <= best:
            level = L - size
        window = self.open[level].pop() if level else []
        if level:
            count[level] -= 1
        window.append(piece)
        if level + size == L:
            self.emit(window)
        else:
            count[level + size] += 1
            self.open[level + size].append(window)

    def finish(self) -> None:
        """Empty windows into full ones, cutting pieces; then powers of two."""
        left = [(level, w) for level in range(self.length, 0, -1) for w in self.open[level]]
        self.open, self.count = [[] for _ in range(self.length + 1)], np.zeros(self.length + 1, np.int64)
        last = len(left) - 1
        for i, (_, window) in enumerate(left):
            if i > last:
                break
            level = sum(len(p[2]) for p in window)  # the last source has given some
            while level < self.length and last > i:
                source = left[last][1]
                taken, rest = cut(source.pop(), self.length - level)
                window.append(taken)
                level += len(taken[2])
                if rest:
                    source.append(rest)
                if not source:
                    last -= 1
            if level == self.length:
                self.emit(window)
                continue
            window = window[::-1]
            for bit in range(self.length.bit_length(), -1, -1):
                need = level & (1 << bit)
                part = []
                while need:
                    taken, rest = cut(window.pop(), need)
                    part.append(taken)
                    need -= len(taken[2])
                    if rest:
                        window.append(rest)
                if part:
                    self.emit(part)


def cut(piece: tuple, most: int) -> tuple:
    doc_id, start, ids, n = piece
    return (doc_id, start, ids[:most], n), (doc_id, start + most, ids[most:], n) if len(ids) > most else None


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048, special: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document: which ids, in which sequence, where; sequence ids are unique, not dense."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, rows, sequence = encoder(tokenizer, special), [], TaskContext.get().partitionId() << 40

        def emit(window: list) -> None:
            nonlocal sequence
            offset = 0
            for doc_id, start, ids, n in window:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, sequence, offset))
                offset += len(ids)
            sequence += 1

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])
            rows.clear()
            return made

        packer, end = Packer(length, emit), np.array([end_id], "<u4")
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                packer.add(doc_id, np.concatenate([ids, end]))
                if len(rows) >= 8192:
                    yield batch_of()
        packer.finish()
        if rows:
            yield batch_of()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, OUT)
