"""Token-id output: flat unsigned integer files plus 64-bit document offsets, read back memory-mapped.

Format of a folder. For each range of document ids, in ascending order, a part: ``part-00000.bin`` holds the ids of its
documents one after another (unsigned 16-bit little-endian where the vocabulary allows, else 32-bit), ``part-00000.off``
n + 1 signed 64-bit offsets into it, ``part-00000.doc`` n signed 64-bit document ids (the least value stands for null).
``meta.json`` holds the id width and, for each part, its documents, its ids and its base: the number of ids in all parts
before it, a prefix sum over one number a part.

Cases: a null text is an empty one and so only the end id; rows that repeat a doc_id stay, ordered by a hash of their text (ranges are of
id and text hash, so that one id, or none, may fill many parts); very long texts are encoded whole, a part's file grows with
them; an empty table gives no parts; extra columns are left out. A special token's string in a text becomes its id, or ordinary
text with special=False. A retried task writes the same bytes and replaces its file whole.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisia.llm.common import partitions, text_of
from decisia.llm.encoding import encoder

NO_ID = -(2**63)
#: Ids read from a file at once.
READ_IDS = 1 << 20
OUT = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Folder:
    """Files of a shared folder: a local or mounted path by the operating system, any other address by Arrow's file systems."""

    def __init__(self, address: str) -> None:
        at = urlparse(address)
        self.local = at.scheme in ("", "file")
        if self.local:
            self.path = at.path
        else:
            from pyarrow import fs

            self.fs, self.path = fs.FileSystem.from_uri(address)

    def make(self) -> None:
        os.makedirs(self.path, exist_ok=True) if self.local else self.fs.create_dir(self.path, recursive=True)

    def writer(self, name: str):
        return _Whole(self, name)

    def array(self, name: str, dtype: str):
        """Something to slice: a memory map of a local file, ranges read from any other store."""
        path = f"{self.path}/{name}"
        if not self.local:
            return _Ranges(self.fs.open_input_file(path), np.dtype(dtype))
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)


class _Ranges:
    """Slices of a remote file of numbers: each is one read, nothing else is held."""

    def __init__(self, file, dtype: np.dtype) -> None:
        self.file, self.dtype, self.n = file, dtype, file.size() // dtype.itemsize

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, some: slice) -> np.ndarray:
        a, b, _ = some.indices(self.n)
        return np.frombuffer(self.file.read_at(max(0, b - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype)


class _Whole:
    """A file that appears under its name only when it is complete."""

    def __init__(self, folder: Folder, name: str) -> None:
        self.folder, self.to, self.by = folder, f"{folder.path}/{name}", f"{folder.path}/.{name}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.file = open(self.by, "wb") if self.folder.local else self.folder.fs.open_output_stream(self.by)
        return self.file

    def __exit__(self, kind, *_) -> None:
        self.file.close()
        if kind is None:
            os.replace(self.by, self.to) if self.folder.local else self.folder.fs.move(self.by, self.to)


def write_tokens(docs: DataFrame, address: str, tokenizer: str, end_id: int, special: bool = True, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode every whole text, append end_id, write the folder; returns what meta.json holds.

    One shuffle deals the documents by ranges of their ids; only one row of counts for each part reaches the driver.
    """
    spark = docs.sparkSession
    vocabulary = encoder(tokenizer, special).tokenizer.get_vocab_size()
    dtype = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    Folder(address).make()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, part = Folder(address), TaskContext.get().partitionId()
        name, enc = f"part-{part:05d}", encoder(tokenizer, special)
        ids, offsets, total = [], [0], 0
        with folder.writer(f"{name}.bin") as out:
            for batch in batches:
                ids.append(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False))
                for tokens in enc.encode(batch.column(1).to_pylist()):
                    out.write(tokens.astype(dtype).tobytes())
                    out.write(np.array([end_id], dtype).tobytes())
                    total += len(tokens) + 1
                    offsets.append(total)
        if total:
            for kind, values in (("off", np.array(offsets, "<i8")), ("doc", np.concatenate(ids).astype("<i8"))):
                with folder.writer(f"{name}.{kind}") as out:
                    out.write(values.tobytes())
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(offsets) - 1], "ids": [total]})

    rows = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
        .repartitionByRange(partitions(spark), F.col("doc_id"), F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
        .mapInArrow(write, "part long, docs long, ids long")
        .collect()
    )
    parts, base = [], 0
    for row in sorted(rows):
        parts.append({"part": row["part"], "docs": row["docs"], "ids": row["ids"], "base": base})
        base += row["ids"]
    meta = {"dtype": dtype, "end_id": end_id, "ids": base, "parts": parts}
    with Folder(address).writer("meta.json") as out:
        out.write(json.dumps(meta).encode())
    return meta


def checksums(ids, at: list[int]) -> list[int]:
    """Of the documents between the places at; read in ranges of a few megabytes."""
    out, k = [], 0
    while k < len(at) - 1:
        last = k + 1
        while last < len(at) - 1 and at[last + 1] - at[k] <= READ_IDS:
            last += 1
        if last == k + 1:  # one document alone, in steps
            found = 0
            for lo in range(at[k], at[last], READ_IDS):
                found = zlib.crc32(ids[lo : min(at[last], lo + READ_IDS)].astype("<u4").tobytes(), found)
            out.append(found)
        else:
            block = ids[at[k] : at[last]].astype("<u4")
            out += [zlib.crc32(block[a - at[k] : b - at[k]].tobytes()) for a, b in zip(at[k:last], at[k + 1 : last + 1], strict=True)]
        k = last
    return out


def read_tokens(spark: SparkSession, address: str, meta: dict) -> DataFrame:
    """One row a document, from the files: where its ids start among all ids, how many, and their checksum as 32-bit integers."""
    dtype = meta["dtype"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(address)
        for batch in batches:
            for part, base in zip(batch["part"].to_pylist(), batch["base"].to_pylist(), strict=True):
                name = f"part-{part:05d}"
                ids, offsets, docs = (folder.array(f"{name}.{kind}", t) for kind, t in (("bin", dtype), ("off", "<i8"), ("doc", "<i8")))
                for lo in range(0, len(docs), 8192):
                    hi = min(len(docs), lo + 8192)
                    at = offsets[lo : hi + 1].tolist()
                    sums = checksums(ids, at)
                    doc = np.asarray(docs[lo:hi])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, mask=doc == NO_ID), pa.array(np.array(at[:-1]) + base), pa.array(np.diff(at)), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    rows = [(p["part"], p["base"]) for p in meta["parts"]]
    return spark.createDataFrame(rows, "part long, base long").repartition(max(1, len(rows))).mapInArrow(read, OUT)
