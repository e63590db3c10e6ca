"""How the sources of a language differ in their words, by exact smoothed shares.

Terms are runs of letters: A-Z lower-cased, every sign beyond ASCII as it is. A language keeps the terms that at least min_docs of its documents hold.
With count n of a term in a group, N over all V kept terms, its share is p = 1 + floor(scale * (n + smoothing) / (N + smoothing * V)); a group is a (language,
source), and the language as a whole has shares as well. Part `pair` gives, for each group and each other source of its language, the sum of abs(p - q) over
all kept terms; part `term` the terms of a group that are more frequent there than in the language, by p - q, the first `top` of them.

The sums of pairs rest on deduplicated count columns: terms whose counts in all sources are alike have one sparse vector (source, count), which is evaluated
once for all pairs of sources and weighted by the number of its terms. Original terms are only ranked, at most `top` of a group in each task before the exchange.

Tasks count words in bounded tables before anything is shuffled, so a hot source or a frequent word is a row a table. Pairs of sources are summed up in
tiles of TILE by TILE; a language with more sources has several, and its vectors go to each. What reaches the driver and is broadcast is a row a group
(max_groups of them are the bound, an error beyond: there would be that number squared of pairs).

Cases: null text, language and source are empty strings, which are values as any other; a group without a kept term has only smoothing, a language without any
has value 0 for its pairs; long texts are read in blocks; ties go to the smaller name in the order of UTF-8; rows that repeat count each; an empty table gives no rows; extra columns
are left out. All numbers are integers of 64 bits, exact up to 9e15 words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decisia.llm.common import text_of, written

#: Words of a task's tables before they are given off, bytes of a long text at a time, sources of a tile, cells of a block of vectors.
HELD_WORDS, BLOCK_BYTES, TILE, CELLS = 250_000, 4 << 20, 1024, 1 << 20

#: Letters and all beyond ASCII are kept, A-Z as a-z; anything else is a space.
KEPT = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_in_blocks(text: str) -> Iterator[list[bytes]]:
    data, lo = text.encode().translate(KEPT), 0
    while lo < len(data):
        hi = data.find(b" ", lo + BLOCK_BYTES)
        hi = len(data) if hi < 0 else hi
        yield data[lo:hi].split()
        lo = hi


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs from lang, source, text: a task's words, and a row with an empty term for each group that it met."""
    names = ["lang", "source", "term", "n", "docs"]
    groups: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            rows = len(n) + 1
            columns = [pa.repeat(pa.scalar(x, pa.string()), rows) for x in (lang, source)]
            terms = pa.array([b"", *n], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())], names=names)

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before, met = len(n), set()
            for words in words_in_blocks(text.as_py()):
                n.update(words)
                met.update(words)
            docs.update(met)
            held += len(n) - before
            if held > HELD_WORDS:
                yield from given()
                groups, held = {}, 0
    yield from given()


def share(n: np.ndarray, total: np.ndarray, scale: int) -> np.ndarray:
    """1 + floor(scale * n / total) for n <= total, by long division in steps of a thousand so that no product overflows."""
    rest, out = n, np.zeros(np.broadcast(n, total).shape, np.int64)
    while scale > 1:
        step = min(scale, 1000)
        rest = rest * step
        out = out * step + rest // total
        rest = rest % total
        scale //= step
    return out + 1


class Sources:
    """Of each language its sources in order and their denominators."""

    def __init__(self, rows: list, smoothing: int, scale: int) -> None:
        self.smoothing, self.scale = smoothing, scale
        found: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: (r["lang"], r["source"].encode())):
            found.setdefault(r["lang"], []).append((r["source"], r["n"] + smoothing * r["v"]))
        self.names = {k: [x[0] for x in v] for k, v in found.items()}
        self.totals = {k: np.array([x[1] for x in v], np.int64) for k, v in found.items()}
        self.place = {k: {s: i for i, s in enumerate(v)} for k, v in self.names.items()}

    def shares(self, lang: str, counts: np.ndarray) -> np.ndarray:
        return share(counts + self.smoothing, self.totals[lang], self.scale)


def summed_pairs(vectors: DataFrame, sources: Sources) -> DataFrame:
    """lang, source, item, value from lang, tile, vector, terms: each pair of sources once a vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(sources)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, key, sums = sent.value, None, None

        def given() -> Iterator[pa.RecordBatch]:
            if key is None:
                return
            names, (i, j) = known.names[key[0]], (int(x) * TILE for x in key[1].split(","))
            for a, row in enumerate(sums):
                at = np.flatnonzero(row)
                if len(at):
                    columns = [pa.repeat(pa.scalar(x, pa.string()), len(at)) for x in (key[0], names[i + a])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([names[j + b] for b in at.tolist()], pa.string()), pa.array(row[at])], names=["lang", "source", "item", "value"])

        for batch in batches:
            langs, tiles, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            weights = batch.column(3).to_numpy()
            lo = 0
            while lo < len(langs):
                hi = lo + 1
                here, most = (langs[lo], tiles[lo]), max(1, CELLS // len(known.names[langs[lo]]))
                while hi < len(langs) and (langs[hi], tiles[hi]) == here and hi - lo < most:
                    hi += 1
                if here != key:
                    yield from given()
                    key = here
                    a, b = (slice(int(x) * TILE, (int(x) + 1) * TILE) for x in here[1].split(","))
                    sums = np.zeros((len(known.names[here[0]][a]), len(known.names[here[0]][b])), np.int64)
                place, some = known.place[here[0]], lists.slice(lo, hi - lo)
                cells = some.flatten()
                counts = np.zeros((hi - lo, len(place)), np.int64)
                counts[np.repeat(np.arange(hi - lo), some.value_lengths().to_numpy()), [place[s] for s in cells.field("source").to_pylist()]] = cells.field("n").to_numpy()
                p = known.shares(here[0], counts)
                for k, column in enumerate(p[:, a].T):
                    sums[k] += weights[lo:hi] @ np.abs(p[:, b] - column[:, None])
                lo = hi
        yield from given()

    return vectors.mapInArrow(run, "lang string, source string, item string, value long")


def share_of(n: Column, total: Column, scale: int) -> Column:
    """The same of columns."""
    out, rest = F.lit(0).cast("long"), n
    while scale > 1:
        step = min(scale, 1000)
        rest = rest * F.lit(step).cast("long")
        out = out * F.lit(step).cast("long") + F.round((rest - rest % total) / total).cast("long")  # a whole number up to a thousand, so doubles tell it
        rest = rest % total
        scale //= step
    return out + F.lit(1).cast("long")


def audit(
    docs: DataFrame, min_docs: int = 30, top: int = 50, smoothing: int = 5, scale: int = 1_000_000_000, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", max_groups: int = 1_000_000
) -> DataFrame:
    """lang, source, part, item, value, rank."""
    rows = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text"))
    words = rows.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    counts = written(words.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    vector = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector")
    kept = written(counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), vector).where(F.col("docs") >= min_docs).drop("docs"), "kept")
    within = kept.select("lang", F.inline("vector")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    groups = counts.where("term = ''").select("lang", "source").distinct().join(within, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    groups = written(groups, "groups")
    listed = groups.limit(max_groups + 1).collect()
    if len(listed) > max_groups:
        raise ValueError(f"more than {max_groups} groups of language and source")
    value = pairs(kept, groups, Sources(listed, smoothing, scale)).unionByName(terms(kept, groups, smoothing, scale))
    place = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return value.withColumn("rank", place).where((F.col("part") == "pair") | (F.col("rank") <= top))


def pairs(kept: DataFrame, groups: DataFrame, sources: Sources) -> DataFrame:
    """Each group with each other source of its language."""
    most = max((len(x) for x in sources.names.values()), default=0)
    tiles = (most + TILE - 1) // TILE
    each = [(lang, f"{i},{j}") for lang, names in sources.names.items() for i in range((len(names) + TILE - 1) // TILE) for j in range(i, (len(names) + TILE - 1) // TILE)]
    vectors = kept.groupBy("lang", "vector").agg(F.count("*").alias("terms"))
    if tiles > 1:
        vectors = vectors.join(F.broadcast(kept.sparkSession.createDataFrame(each, "lang string, tile string")), "lang")
    else:
        vectors = vectors.withColumn("tile", F.lit("0,0"))
    found = summed_pairs(vectors.select("lang", "tile", "vector", "terms").sortWithinPartitions("lang", "tile"), sources).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # a tile beside the diagonal has each pair once, one on it has both orders
    both = found.unionByName(found.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).distinct()
    others = groups.select("lang", F.col("source").alias("item"))
    whole = groups.select("lang", "source").join(others, "lang").where("source <> item").join(both, ["lang", "source", "item"], "left")
    return whole.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def terms(kept: DataFrame, groups: DataFrame, smoothing: int, scale: int) -> DataFrame:
    """Each group's own terms that are more frequent there than in the language."""
    cells = kept.select("lang", "term", "total", F.inline("vector").alias("source", "count")).join(groups, ["lang", "source"])
    p, q = (share_of(F.col(n) + smoothing, F.col(all_) + smoothing * F.col("v"), scale) for n, all_ in (("count", "n"), ("total", "n_lang")))
    found = cells.withColumn("value", p - q).where("count > 0 and value > 0")
    return found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
