"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a whole text: hashed byte trigrams, hashed 4-grams of its character classes, and coarse facts of its words (how
many, how many differ, how often a word repeats the last one, shares of capitals and signs). Logged counts times inverse
document frequencies, each family scaled to length one, are projected on the leading singular vectors of the labelled
sample. Each document's vector meets all labelled vectors in blocked exact products; the labels of the nearest vote with
weights that grow with their cosine.

The labelled sample has max_labelled rows at most (4096): of the labelled ids that documents hold, those with the least hash; that
bound is the size of what is fitted on the driver (terms by dims) and broadcast. An id that labels several rows counts once, by the
text of the least hash; only the rows of the sample are shuffled for it. All documents are scored, in one pass without a shuffle.

Cases: null and empty texts have the facts of no words and are scored by them; a very long text is counted in blocks, so that memory
doesn't grow with it; every row of a repeated id is scored by its own text; ties at the border of the nearest go to the earlier
vectors of the sample, whose order is fixed by labels and terms; labels that are null, repeated (the greatest counts) or of absent
documents are left out before the sample is drawn; without any usable label every score is 0.5 and keep_good keeps all; an empty table
gives no rows; extra columns are left out by score and passed through by keep_good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisia.llm.common import text_of
from decisia.llm.words import SPACES, Words

TRIGRAMS, SHAPES, FACTS = 2048, 1024, 128
TERMS = TRIGRAMS + SHAPES + FACTS
CHUNK_BYTES, BLOCK = 1_000_000, 256

#: Character classes: letters, capitals, digits, blanks, line ends, and each other sign its own.
CLASSES = np.arange(256, dtype=np.uint32)
CLASSES[97:123] = CLASSES[128:] = 1
CLASSES[65:91], CLASSES[48:58], CLASSES[[9, 11, 12, 13, 32]], CLASSES[10] = 2, 3, 4, 5
CAPITAL, SIGN = np.zeros(256, bool), np.zeros(256, bool)
CAPITAL[65:91] = True
SIGN[33:48] = SIGN[58:65] = SIGN[91:97] = SIGN[123:127] = True


def facts(n_bytes: int, capitals: int, signs: int, words: int, distinct: int, same: int) -> np.ndarray:
    """A coarse one-hot of each fact, with its neighbours at half."""
    shares = (np.log2(words + 1) / 16, distinct / max(1, words), same / max(1, words), capitals / max(1, n_bytes), signs / max(1, n_bytes) * 3, np.log2(n_bytes + 1) / 24)
    out = np.zeros(FACTS, np.float32)
    for k, share in enumerate(shares):
        at = 1 + min(18, int(share * 18))
        out[20 * k + at] = 1
        out[20 * k + at - 1] += 0.5
        out[20 * k + at + 1] += 0.5
    return out


def trigrams(buf: np.ndarray) -> np.ndarray:
    b = buf.astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(21)).astype(np.int32) if len(b) > 2 else np.empty(0, np.int32)


def shapes(buf: np.ndarray) -> np.ndarray:
    c = CLASSES[buf]
    return ((c[:-3] * np.uint32(0x9E3779B1) + c[1:-2] * np.uint32(0x85EBCA77) + c[2:-1] * np.uint32(0xC2B2AE3D) + c[3:] * np.uint32(0x27D4EB2F)) >> np.uint32(22)).astype(np.int32) if len(c) > 3 else np.empty(0, np.int32)


def terms(texts: list[bytes]) -> np.ndarray:
    """Texts by terms: logged counts and facts. Short texts are counted together, a long one in blocks."""
    out = np.zeros((len(texts), TERMS), np.float32)
    short = [i for i, t in enumerate(texts) if len(t) <= CHUNK_BYTES]
    if short:
        out[short] = counted([texts[i] for i in short])
    for i in set(range(len(texts))) - set(short):
        out[i] = counted_in_blocks(texts[i])
    np.log1p(out[:, : TRIGRAMS + SHAPES], out=out[:, : TRIGRAMS + SHAPES])
    return out


def counted(texts: list[bytes]) -> np.ndarray:
    found = Words(texts)
    hashes, buf = found.hashes(), found.buf
    tri, shape = trigrams(buf), shapes(buf)
    capital, sign = (np.concatenate([[0], np.cumsum(x[buf])]) for x in (CAPITAL, SIGN))
    out = np.zeros((len(texts), TERMS), np.float32)
    at, first = found.at.tolist(), found.first.tolist()
    for i in range(len(texts)):
        a, e = at[i], at[i + 1] - 1
        words = hashes[first[i] : first[i + 1]]
        out[i, :TRIGRAMS] = np.bincount(tri[a : max(a, e - 2)], minlength=TRIGRAMS)
        out[i, TRIGRAMS : TRIGRAMS + SHAPES] = np.bincount(shape[a : max(a, e - 3)], minlength=SHAPES)
        out[i, TRIGRAMS + SHAPES :] = facts(e - a, int(capital[e] - capital[a]), int(sign[e] - sign[a]), len(words), len(np.unique(words)), int((words[1:] == words[:-1]).sum()))
    return out


def counted_in_blocks(text: bytes) -> np.ndarray:
    """The same of one text: signs in blocks that overlap by a run less one, words in blocks that end at a blank."""
    out, buf = np.zeros(TERMS, np.float64), np.frombuffer(text, np.uint8)
    capitals = signs = 0
    for lo in range(0, len(buf), CHUNK_BYTES):
        block = buf[lo : lo + CHUNK_BYTES + 3]
        out[:TRIGRAMS] += np.bincount(trigrams(block[: CHUNK_BYTES + 2]), minlength=TRIGRAMS)
        out[TRIGRAMS : TRIGRAMS + SHAPES] += np.bincount(shapes(block), minlength=SHAPES)
        capitals += int(CAPITAL[block[:CHUNK_BYTES]].sum())
        signs += int(SIGN[block[:CHUNK_BYTES]].sum())
    words, same, last, distinct, lo = 0, 0, None, np.empty(0, np.uint64), 0
    while lo < len(buf):
        hi = min(len(buf), lo + CHUNK_BYTES)
        while hi < len(buf) and not SPACES[buf[hi]]:  # a word longer than a block makes its block longer
            blanks = np.flatnonzero(SPACES[buf[hi : hi + CHUNK_BYTES]])
            hi = hi + int(blanks[0]) if len(blanks) else min(len(buf), hi + CHUNK_BYTES)
        h = Words([text[lo:hi]]).hashes()
        if len(h):
            words += len(h)
            same += int((h[1:] == h[:-1]).sum()) + (last is not None and h[0] == last)
            last = h[-1]
            distinct = np.union1d(distinct, h)
        lo = hi
    out[TRIGRAMS + SHAPES :] = facts(len(buf), capitals, signs, words, len(distinct), int(same))
    return out.astype(np.float32)


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """In place: terms are made for one use."""
    x *= idf
    for a, e in ((0, TRIGRAMS), (TRIGRAMS, TRIGRAMS + SHAPES), (TRIGRAMS + SHAPES, TERMS)):
        x[:, a:e] /= np.maximum(1e-9, np.linalg.norm(x[:, a:e], axis=1, keepdims=True))
    return x


def leading(x: np.ndarray, dims: int, rounds: int = 8) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start: memory of a few blocks of dims columns."""
    q = np.random.Generator(np.random.PCG64(11)).standard_normal((x.shape[1], min(dims + 16, x.shape[1])), dtype=np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ v.T)[:, :dims])


class Model:
    """idf, projection (terms by dims), unit vectors and labels of the sample."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, dims: int, neighbours: int, power: float) -> None:
        self.neighbours, self.power, self.labels = neighbours, power, labels.astype(np.float32)
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
        x = weighted(x, self.idf)
        self.projection = leading(x, min(dims, len(x)))
        self.vectors = self.unit(x)

    def unit(self, x: np.ndarray) -> np.ndarray:
        v = x @ self.projection
        return v / np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Exact cosines of a block of documents with every labelled vector; the nearest vote."""
        cosine = self.unit(weighted(x, self.idf)) @ self.vectors.T
        k = min(self.neighbours, cosine.shape[1])
        border = np.partition(cosine, -k, axis=1)[:, -k][:, None]
        above, level = cosine > border, cosine == border
        level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)  # ties at the border: the first ones
        row, near = np.nonzero(above | level)
        weight = np.maximum(cosine[row, near], 1e-6).astype(np.float64) ** self.power
        return np.clip(np.bincount(row, weight * self.labels[near], len(x)) / np.bincount(row, weight, len(x)), 0, 1)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and texts of a few megabytes at a time; a longer text comes alone."""
    for batch in batches:
        texts = [t.encode() for t in batch.column(1).to_pylist()]
        lo, size = 0, 0
        for i, t in enumerate(texts):
            if i > lo and (size + len(t) > CHUNK_BYTES or i - lo >= BLOCK):
                yield batch.column(0).slice(lo, i - lo), texts[lo:i]
                lo, size = i, 0
            size += len(t)
        if lo < len(texts):
            yield batch.column(0).slice(lo), texts[lo:]


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 4096, dims: int = 128, neighbours: int = 15, power: float = 4.0) -> Model | None:
    """Labels of held-out rows are never read."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    present = usable.join(docs.select(F.col(id_col).alias("_present")).distinct(), F.col("_id") == F.col("_present"), "left_semi")
    drawn = F.broadcast(present.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled))
    found = docs.join(drawn, docs[id_col] == drawn["_id"]).select(drawn["_id"], drawn["_label"], text_of(text_col).alias("_text"))
    sample = found.groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("_text"), "_text"))["_text"].alias("_text")).select("_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([label.cast(pa.int32()), pa.array([x.astype(np.float16).tobytes() for x in terms(texts)], pa.binary())], names=["label", "x"])

    rows = sample.mapInArrow(run, "label int, x binary").toArrow()
    if not rows.num_rows:
        return None
    x, y = np.empty((rows.num_rows, TERMS), np.float32), rows["label"].to_numpy()
    for i, row in enumerate(rows["x"]):
        x[i] = np.frombuffer(row.as_buffer(), np.float16)
    del rows
    order = np.lexsort((np.ascontiguousarray(x).view(np.uint32).sum(axis=1), y))  # the same model in whatever order rows come
    return Model(x[order], y[order], dims, neighbours, power)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(sent.value.score(terms(texts)))], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model | None, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(at).fill_null("")], names=["i", "t"])
            good = [sent.value.score(terms(some)) >= threshold for _, some in chunks(iter([texts]))]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.empty(0, bool)))

    return docs.mapInArrow(run, docs.schema)
