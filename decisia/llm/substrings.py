"""Substring dedup by super-k-mer partitioning of words.

A window is 20 consecutive words. Its minimiser is the 3-word run in it with the least hash; consecutive windows that share a
minimiser travel as one packed string (a super-k-mer, about nine windows) to the minimiser's bucket. Equal windows have equal
minimisers and so meet in one bucket, where windows are sorted by digest, document and start. A window that isn't the first of its run of equals covers its words;
the covers go back to their documents by id.

Windows are equal if their 128-bit digests are, in chunks, buckets and beyond alike. A digest is of the words' hashes of 64 bits; two unequal windows
pass for equal only if they differ in words whose hashes agree, which has a probability of 2^-64 for each pair of windows that differ in one word alone, and less for others.

Scale: a task works through its documents in chunks of a few megabytes. Of equal windows in a chunk only the first travels,
the others are known to be repeats, so a passage in a third of all documents reaches its bucket once a chunk. Minimisers
that hold more than their share of windows, counted over all documents beforehand (a chunk reports those above half of the
share, so at most two a share), have their windows dealt one by one by the hash of the whole window: no bucket gathers
them. Strings are compressed a chunk and bucket. Buckets are as many as all text asks for.

That count only spares work; no result or bound rests on it. A bucket is read as a stream: beyond HELD_BYTES of strings it goes on without the strings, with
the digests of windows alone, keeps of equal ones the least place met so far and gives the others off as repeats, so that millions of
copies of one window take the room of one. A bucket of more than HELD_WINDOWS different windows gives them off too, as rows; they meet again
by digest in an aggregation that combines equal ones in every task before its exchange.

Order is by doc_id (null first), then start; rows that repeat an id with the same text don't cover each other, with another
text they are ordered by its hash. Cases: null and short texts have no windows; a very long text is a chunk of its own, whose words are hashed
in blocks; an empty table gives no rows; extra columns are left out by the query, and kept_text is the text without covered
words, joined by spaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisia.llm.common import partitions, text_of, written
from decisia.llm.words import Words, mixed, other_runs, runs, sliding_min, within_texts

WINDOW, MINIMISER = 20, 3
CHUNK_BYTES, BUCKET_BYTES = 4_000_000, 5_000_000
HELD_BYTES, HELD_WINDOWS = 20_000_000, 1_000_000
NO_ID = -(2**63)


class Chunk:
    """The windows of some documents, in the order of ids; first marks those that travel."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, texts: list[bytes]) -> None:
        order = np.lexsort((marks, ids))
        self.ids, self.marks = ids[order], marks[order]
        self.words = Words([texts[i] for i in order.tolist()])
        self.h = self.words.hashes()
        self.at = within_texts(self.words.first, WINDOW)
        if not len(self.at):
            return
        self.window = runs(self.h, WINDOW)[self.at]
        self.least = sliding_min(runs(self.h, MINIMISER), WINDOW - MINIMISER + 1)[self.at]
        self.doc = np.searchsorted(self.words.first, self.at, side="right") - 1
        self.start = self.at - self.words.first[self.doc]

    def earlier(self) -> np.ndarray:
        """Which windows have an equal one earlier in the chunk."""
        return repeats(self.window, other_runs(self.h, WINDOW)[self.at], self.ids[self.doc], self.marks[self.doc], self.start)


def repeats(window: np.ndarray, other: np.ndarray, ids: np.ndarray, marks: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows equal one of an earlier place, by both halves of their digests. Windows come in the order of their places."""
    order = np.argsort(window, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = window[order[1:]] != window[order[:-1]]
    if new.all():
        return np.zeros(len(order), bool)
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # of each, the first with its hash
    if (other[head] != other[order]).any():  # first halves that are alike by chance
        order = np.lexsort((other, window))
        new[1:] = (window[order[1:]] != window[order[:-1]]) | (other[order[1:]] != other[order[:-1]])
        head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.flatnonzero(~new)
    this, that = order[later], head[later]
    out = np.zeros(len(order), bool)
    out[this] = (ids[this] != ids[that]) | (marks[this] != marks[that]) | (start[this] != start[that])
    return out


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    ids, marks, texts, size = [], [], [], 0
    for batch in batches:
        for i, m, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            ids.append(NO_ID if i is None else i)
            marks.append(m)
            texts.append(t.as_py().encode())
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield Chunk(np.array(ids, np.int64), np.array(marks, np.int64), texts)
                ids, marks, texts, size = [], [], [], 0
    if texts:
        yield Chunk(np.array(ids, np.int64), np.array(marks, np.int64), texts)


def covers(ids: np.ndarray, marks: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive starts: ids, marks, first and last start."""
    if not len(ids):
        return ids, marks, start, start
    cut = np.flatnonzero((ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(ids)]]) - 1
    return ids[a], marks[a], start[a], start[b]


def gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """The slices of buf one after another."""
    to = np.cumsum(size)
    return buf[np.arange(int(to[-1])) + np.repeat(start - to + size, size)].tobytes()


def hot_minimisers(rows: DataFrame, share: float) -> np.ndarray:
    """Minimisers that hold more than the share of the windows, by counts over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunked(batches):
            if len(chunk.at):
                least = chunk.least[~chunk.earlier()]
                found, n = np.unique(least, return_counts=True)
                often = n > max(8, share / 2 * len(least))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(found[often].view(np.int64), 0)), pa.array(np.append(n[often], 0)), pa.array([0] * int(often.sum()) + [len(least)])], names=["m", "n", "total"])

    found = written(rows.mapInArrow(count, "m long, n long, total long").groupBy("m").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "minimisers")
    total = found.agg(F.sum("total")).first()[0] or 0
    return np.array([r["m"] for r in found.where(F.col("n") > share / 2 * total).select("m").collect()], np.int64).view(np.uint64)


def repeated_covers(rows: DataFrame, buckets: int) -> DataFrame:
    """id, mark, a, b: the windows from start a to start b of a document are repeats; without b, the window at a has the digest p, q and is still to be compared. rows: id, mark, text."""
    share = max(1 / (4 * buckets), 1 / 65536)
    hot = np.sort(hot_minimisers(rows, share))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6)
        for chunk in chunked(batches):
            if not len(chunk.at):
                continue
            early = chunk.earlier()
            doc = chunk.doc[early]
            known = covers(chunk.ids[doc], chunk.marks[doc], chunk.start[early])
            if len(known[0]):
                blob = np.stack([x.astype(np.int64) for x in known]).tobytes()
                yield pa.RecordBatch.from_pydict({"bucket": [int(chunk.window[0] % np.uint64(buckets))], "known": [True], "packed": [pack.compress(blob)]})
            keep = ~early
            at, doc, least, window = chunk.at[keep], chunk.doc[keep], chunk.least[keep], chunk.window[keep]
            single = np.isin(least, hot)
            bucket = (np.where(single, window, mixed(least.copy())) % np.uint64(buckets)).astype(np.int64)
            cut = np.ones(len(at), bool)
            cut[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | single[1:] | single[:-1]
            first = np.flatnonzero(cut)
            last = np.concatenate([first[1:], [len(at)]]) - 1
            order = np.argsort(bucket[first], kind="stable")
            first, last = first[order], last[order]
            to = bucket[first]
            edges = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]]) if len(to) else [0]
            out: list[tuple] = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                f, e = first[a:b], last[a:b]
                begin, end = chunk.words.start[at[f]], chunk.words.end[at[e] + WINDOW - 1] + 1
                head = np.stack([chunk.ids[doc[f]], chunk.marks[doc[f]], at[f] - chunk.words.first[doc[f]], e - f + WINDOW]).astype(np.int64)
                out.append((int(to[a]), pack.compress(len(f).to_bytes(8, "little") + head.tobytes() + gather(chunk.words.buf, begin, end - begin))))
                if len(out) >= 64:
                    yield pa.RecordBatch.from_pydict({"bucket": [x[0] for x in out], "known": [False] * len(out), "packed": [x[1] for x in out]})
                    out = []
            if out:
                yield pa.RecordBatch.from_pydict({"bucket": [x[0] for x in out], "known": [False] * len(out), "packed": [x[1] for x in out]})

    def found(columns: tuple[np.ndarray, ...], open_windows: bool = False) -> pa.RecordBatch:
        arrays = [pa.array(np.asarray(c, np.int64)) for c in columns]
        none = pa.nulls(len(arrays[0]), pa.int64())
        arrays = [*arrays[:3], none, *arrays[3:]] if open_windows else [*arrays, none, none]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "mark", "a", "b", "p", "q"])

    def windows(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
        """Document, mark and start of each window in the order of places, with the word hashes and where it stands in them."""
        heads, texts = [], []
        for blob in blobs:
            n = int.from_bytes(blob[:8], "little")
            heads.append(np.frombuffer(blob, np.int64, 4 * n, 8).reshape(4, n))
            texts.append(blob[8 + 32 * n :])
        ids, marks, start, size = np.concatenate(heads, axis=1)
        h = Words(texts).hashes()
        word = np.cumsum(size) - size  # of each string, where its words stand
        order = np.lexsort((start, marks, ids))
        many = size[order] - WINDOW + 1
        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(ids[order], many), np.repeat(marks[order], many), np.repeat(start[order], many) + step, h, np.repeat(word[order], many) + step

    class Bucket:
        """Strings of a bucket as they come; a large one goes on with digests."""

        def __init__(self) -> None:
            self.blobs, self.size, self.kept, self.full = [], 0, None, False

        def add(self, blob: bytes) -> Iterator[pa.RecordBatch]:
            self.blobs.append(blob)
            self.size += len(blob)
            if self.size > HELD_BYTES:
                yield from self.digested()

        def digested(self) -> Iterator[pa.RecordBatch]:
            doc, mark, begin, h, at = windows(self.blobs)
            new = np.stack([doc, mark, begin, runs(h, WINDOW)[at].view(np.int64), other_runs(h, WINDOW)[at].view(np.int64)])
            self.blobs, self.size = [], 0
            both = new if self.kept is None else np.concatenate([self.kept, new], axis=1)
            both = both[:, np.lexsort(both[[2, 1, 0, 4, 3]])]
            first = np.ones(both.shape[1], bool)
            first[1:] = (both[3:, 1:] != both[3:, :-1]).any(axis=0)
            least = both[:3, np.flatnonzero(first)[np.cumsum(first) - 1]]
            again = both[:3, (both[:3] != least).any(axis=0)]  # the same place twice is a repeated row
            order = np.lexsort(again[::-1])
            yield found(covers(*again[:, order]))
            self.kept = both[:, first]
            self.full |= self.kept.shape[1] > HELD_WINDOWS
            if self.full:
                for lo in range(0, self.kept.shape[1], 100_000):
                    yield found(tuple(self.kept[:, lo : lo + 100_000]), open_windows=True)
                self.kept = None

        def close(self) -> Iterator[pa.RecordBatch]:
            if self.blobs and (self.full or self.kept is not None):
                yield from self.digested()
            elif self.blobs:
                doc, mark, begin, h, at = windows(self.blobs)
                again = repeats(runs(h, WINDOW)[at], other_runs(h, WINDOW)[at], doc, mark, begin)
                yield found(covers(doc[again], mark[again], begin[again]))

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, now, held = zstandard.ZstdDecompressor(), None, Bucket()
        for batch in batches:
            for bucket, known, packed in zip(*(batch.column(i) for i in range(3)), strict=True):
                blob = unpack.decompress(packed.as_py())
                if known.as_py():
                    yield found(tuple(np.frombuffer(blob, np.int64).reshape(4, -1)))
                    continue
                if bucket.as_py() != now:
                    yield from held.close()
                    now, held = bucket.as_py(), Bucket()
                yield from held.add(blob)
        yield from held.close()

    dealt = rows.mapInArrow(deal, "bucket long, known boolean, packed binary").repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(sort_out, "id long, mark long, a long, b long, p long, q long")


def compared(found: DataFrame) -> DataFrame:
    """The repeats, those among the windows that were given off included."""
    rest = found.where("b is null")
    place = F.struct("id", "mark", "a")
    least = rest.groupBy("p", "q").agg(F.min(place).alias("least"))
    again = rest.join(least, ["p", "q"]).where(place != F.col("least")).select("id", "mark", "a", F.col("a").alias("b"))
    return found.where("b is not null").select("id", "mark", "a", "b").unionAll(again)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every document."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_of(text_col)).alias("mark"), text_of(text_col).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, total * 3 // BUCKET_BYTES)
    found = written(repeated_covers(rows, buckets), "covers", compression="zstd")
    found = compared(found).groupBy("id", "mark").agg(F.collect_list(F.struct("a", "b")).alias("covers"))
    joined = rows.join(found, ["id", "mark"], "left").select("id", "text", "covers")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, gone, digests, kept = [], [], [], [], []
            for i, text, ranges in zip(*(batch.column(k) for k in range(3)), strict=True):
                words = text.as_py().encode().split()
                left = words
                if ranges.is_valid and len(ranges):
                    stay = np.zeros(len(words) + 1, np.int64)
                    pairs = ranges.values.flatten()
                    np.add.at(stay, pairs[0].to_numpy(), 1)
                    np.add.at(stay, pairs[1].to_numpy() + WINDOW, -1)
                    left = [words[k] for k in np.flatnonzero(np.cumsum(stay[:-1]) == 0).tolist()]
                joined = b" ".join(left)
                ids.append(None if i.as_py() == NO_ID else i.as_py())
                n.append(len(words))
                gone.append(len(words) - len(left))
                digests.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return joined.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
