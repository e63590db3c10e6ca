"""Language by hyperdimensional profiles.

Every letter has a random vector of ones and minus ones, drawn from its code point. An n-gram of signs is bound into one vector: the vectors of its letters,
rotated by their place, multiplied. A text's vector is the bundle (sum) of the vectors of all its n-grams, a language's prototype that of all its texts; a text
gets the language whose prototype has the greatest cosine with it.

Signs are letters (Unicode category L) as lower case, and one blank for whatever lies between them, also before the first and behind the last. What is alike in all
languages tells nothing of any, so the mean of the unit prototypes is taken from prototypes and texts before they are compared. The score is the share of the best language among all, by
exponentials of the cosines.

Prototypes are learnt from all documents that aren't held out (crc32 of the id modulo 3 is 1), in one pass: bundles are linear, so tasks count n-grams by
language and bundle distinct n-grams once, and give off one vector a language. Lang of held-out documents is never read for learning; lang, source and id are no inputs of a
prediction. The second pass predicts, without a shuffle. The prototypes (dims numbers a language, max_langs of them at most, an error beyond) are all that reaches the driver.

Cases: null texts, and texts without a letter, get `und` and score 0; without any prototype all do; empty strings as lang are a language as any other, null ones teach nothing; long texts
are read in blocks; of equal cosines the language that is first in order wins; rows that repeat count each; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisia.llm.memory import thrifty

thrifty()

BLANK, CHUNK, MOST_TEXTS, NGRAMS = np.uint32(32), 500_000, 256, 8192
UND = "und"


@functools.cache
def signs() -> np.ndarray:
    """Of each code point its lower case if it is a letter, else a blank."""
    out = np.full(0x110000, BLANK, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letters(points: np.ndarray, dims: int) -> np.ndarray:
    """The vectors of code points: bits of a hash of the point and the word's place, as ones and minus ones."""
    with np.errstate(over="ignore"):
        words = mixed(mixed(points.astype(np.uint64) + np.uint64(1))[:, None] + np.arange(1, dims // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(points), -1), axis=1)
    return (bits.astype(np.int8) * 2 - 1)[:, :dims]


def stream(text: str, last: bool, before: np.ndarray) -> np.ndarray:
    """The signs of a block, runs of blanks as one, behind those of the block before that its n-grams need."""
    found = signs()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    whole = np.concatenate([before if len(before) else [BLANK], found, [BLANK] if last else np.empty(0, np.uint32)]).astype(np.uint32)
    keep = np.ones(len(whole), bool)
    keep[1:] = (whole[1:] != BLANK) | (whole[:-1] != BLANK)
    return whole[keep]


def ranked(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the place of each value among them; by a table where values are below a few million."""
    if size > 1 << 22:
        return np.unique(values, return_inverse=True)
    met = np.zeros(size, bool)
    met[values] = True
    return np.flatnonzero(met), (np.cumsum(met, dtype=np.int32) - 1)[values]


class Bundler:
    """Vectors of texts. n-grams are numbered by the letters of a chunk, so that counting is by small numbers whatever the script."""

    def __init__(self, dims: int, n: int) -> None:
        self.dims, self.n = dims, n

    def bundles(self, streams: list[np.ndarray], of: np.ndarray, rows: int) -> np.ndarray:
        """For each row the sum over the streams that belong to it."""
        out = np.zeros((rows, self.dims), np.float32)
        keep = [i for i, s in enumerate(streams) if len(s) >= self.n]
        if not keep:
            return out
        sizes = np.array([len(streams[i]) for i in keep])
        points, at = ranked(np.concatenate([streams[i] for i in keep]), 0x110000)
        key = np.zeros(len(at) - self.n + 1, np.int64)
        for j in range(self.n):
            key = key * len(points) + at[j : j + len(key)]
        inside = np.ones(len(at), bool)
        ends = np.cumsum(sizes)
        for j in range(1, self.n):
            inside[ends - j] = False
        inside = inside[: len(key)]
        row = np.repeat(of[keep], sizes)[: len(key)][inside]
        keys, place = ranked(key[inside], len(points) ** self.n)
        vectors = letters(points, self.dims)
        turned = [np.roll(vectors, self.n - 1 - j, axis=1) for j in range(self.n)]  # rotated by place
        cell = row * len(keys) + place
        order = None
        for lo in range(0, len(keys), NGRAMS):
            some = keys[lo : lo + NGRAMS]
            bound = np.ones((len(some), self.dims), np.int8)
            rest = some
            for j in range(self.n - 1, -1, -1):
                bound *= turned[j][rest % len(points)]
                rest = rest // len(points)
            if len(keys) <= NGRAMS:
                mine = cell
            else:
                order = np.argsort(place, kind="stable") if order is None else order
                a, b = np.searchsorted(place[order], [lo, lo + len(some)])
                mine = row[order[a:b]] * len(some) + place[order[a:b]] - lo
            counts = np.bincount(mine, minlength=rows * len(some)).reshape(rows, len(some)).astype(np.float32)
            out += counts @ bound.astype(np.float32)
        return out


def blocks(text: str, n: int) -> Iterator[np.ndarray]:
    """The stream of a text in parts that overlap by n - 1 signs."""
    before = np.empty(0, np.uint32)
    for lo in range(0, max(1, len(text)), CHUNK):
        part = stream(text[lo : lo + CHUNK], lo + CHUNK >= len(text), before)
        yield part
        before = part[-(n - 1) :]


def grouped(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, list, list[np.ndarray], np.ndarray]]:
    """The first column, texts, streams and which text each belongs to, of some texts or a part of a long one; a long text's parts come as further yields with no ids."""
    for batch in batches:
        texts = batch.column(1)
        lo = 0
        while lo < batch.num_rows:
            hi, size, streams = lo, 0, []
            while hi < batch.num_rows and hi - lo < MOST_TEXTS and (hi == lo or size < CHUNK):
                text = texts[hi].as_py()
                if text is not None and len(text) > CHUNK:
                    break
                streams.append(stream(text or "", True, np.empty(0, np.uint32)))
                size += len(text or "")
                hi += 1
            if hi > lo:
                yield batch.column(0).slice(lo, hi - lo), texts.slice(lo, hi - lo).is_valid().to_pylist(), streams, np.arange(hi - lo)
            else:
                yield batch.column(0).slice(lo, 1), [True], texts[lo].as_py(), None
                hi = lo + 1
            lo = hi


def vectors_of(streams, of, bundler: Bundler) -> tuple[np.ndarray, np.ndarray]:
    """A vector a text and whether it has a letter; a long text is a sum over its blocks."""
    if of is not None:
        return bundler.bundles(streams, of, len(streams)), np.array([bool((s != BLANK).any()) for s in streams])
    out, some = np.zeros((1, bundler.dims), np.float32), False
    for part in blocks(streams, bundler.n):
        out += bundler.bundles([part], np.zeros(1, np.int64), 1)
        some = some or bool((part != BLANK).any())
    return out, np.array([some])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


class Profiles:
    """Languages in order and their unit prototypes less the mean."""

    def __init__(self, found: dict[str, np.ndarray], dims: int, n: int, sharpness: float) -> None:
        self.dims, self.n, self.sharpness = dims, n, sharpness
        self.langs = sorted(found)
        units = np.array([unit(found[k][None])[0] for k in self.langs]).reshape(len(found), dims)
        self.mean = units.mean(axis=0) if len(found) > 1 else np.zeros(dims)
        self.prototypes = unit(units - self.mean).astype(np.float32)

    def predict(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the best language of each row, and its share."""
        cosine = unit(unit(vectors) - self.mean) @ self.prototypes.T
        best = cosine.argmax(axis=1)
        weight = np.exp(self.sharpness * (cosine - cosine.max(axis=1, keepdims=True)).astype(np.float64))
        return best, 1 / weight.sum(axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))


def fit(docs: DataFrame, dims: int = 1024, n: int = 3, sharpness: float = 12.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_langs: int = 10_000) -> Profiles:
    """Prototypes from all documents that aren't held out and whose language is told."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = Bundler(dims, n), {}
        for langs, _, streams, of in grouped(batches, n):
            names = langs.to_pylist()
            if of is None:
                found = {names[0]: vectors_of(streams, None, bundler)[0][0]}
            else:
                here = {k: i for i, k in enumerate(dict.fromkeys(names))}
                summed = bundler.bundles(streams, np.array([here[k] for k in names]), len(here))
                found = {k: summed[i] for k, i in here.items()}
            for k, v in found.items():
                sums[k] = sums[k] + v if k in sums else v.astype(np.float64)
            if len(sums) > 1000:
                yield given(sums)
                sums = {}
        if sums:
            yield given(sums)

    def given(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*sums], pa.string()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["lang", "v"])

    parts = rows.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    whole = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("v"))
    listed = whole.limit(max_langs + 1).collect()
    if len(listed) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    return Profiles({r["lang"]: np.array(r["v"]) for r in listed}, dims, n, sharpness)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        bundler = Bundler(known.dims, known.n)
        for ids, there, streams, of in grouped(batches, known.n):
            said, score = [UND] * len(ids), np.zeros(len(ids))
            if known.langs:
                found, some = vectors_of(streams, of, bundler)
                best, share = known.predict(found)
                for i in np.flatnonzero(some & np.array(there)).tolist():
                    said[i], score[i] = known.langs[best[i]], share[i]
            yield pa.RecordBatch.from_arrays([ids, pa.array(said, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
