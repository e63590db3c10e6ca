"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a sample (those with the least hash of their ids) that grows with the lists, eight vectors a list, from LEAST_SAMPLE to
max_sample vectors (131,072); every row is indexed: its list is that of the nearest centroid, its code one byte for each part of the residual, which has four
components (16 parts at least). A query looks into the lists of its nearest centroids, at least probes of them and as many more as it takes to hold depth
candidates. There, codes are scored by asymmetric distance tables; the best depth of a query over all its lists are ranked
again by exact distances of the original vectors in double precision, ties to the smaller id.

How well codes and lists tell rows apart depends on the rows, so both bounds are measured on them: the true neighbours of some of the queries (MEASURED, those of the least hash) are found
among all rows by their exact distances; probes grows to the places that the neighbours' lists have, depth to the places that their codes have among all codes in those lists, each
for the share recall of them. Where codes tell nothing, depth grows up to all rows.

Scale: lists grow as the square root of the rows, up to max_lists (16,384, which 270 million rows have; beyond, they grow longer). Neighbouring lists form a group, and a list of more than shard_rows is dealt into shards
by the hash of the id; a shard or group is smaller where there are fewer rows than tasks could share. The queries that ask for a
group form blocks of block_queries, and its codes go to just those blocks, so that a task holds one group of codes and one block
of the queries that want it. Centroids, codebooks and list sizes, broadcast to all tasks, are bounded by max_lists.

Cases: vectors that are null, all zero, hold null or non-finite parts take no part, nor do rows without an id; a length other than the
commonest of the rows has no distance to them, so such rows and queries take no part either. Of a query id that repeats with other
vectors the one of the least hash asks; of a candidate id, the nearest of its vectors counts. Ties go to the smaller id; with
fewer candidates than k a query gets them all; an empty table gives no rows; extra columns are left out. Vectors of doubles are
ranked as doubles; lists and codes are made of floats, scaled by a power of two if most vectors have components beyond what squares of floats can hold, and cut
to that in single vectors beyond it, less their mean; distances whose squares no double holds are worked out from scaled components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decisia.llm.common import partitions, written
from decisia.llm.words import mixed

#: Least parts, components of a part where there are more, and codes of a part.
PARTS, WIDTH, CODES = 16, 4, 256
#: A group of lists isn't made smaller than this for the sake of more tasks.
LEAST_ROWS = 2048
#: Vectors that are sampled where there are as many, and the largest component that is coded as it is.
LEAST_SAMPLE, LARGE = 16_384, 1e15
#: Queries whose true neighbours are looked for among all rows, and least vectors that codes are fitted on.
MEASURED, LEAST_FITTED = 128, 4096


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, rows of x by rows of y."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None], 0)


def nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    block = max(64, min(4096, (1 << 22) // max(1, len(y))))
    return np.concatenate([distances(x[i : i + block], y).argmin(1) for i in range(0, len(x), block)]) if len(x) else np.empty(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centroids at most: distinct rows first, then Lloyd's rounds."""
    centre = np.unique(x, axis=0)
    centre = centre[np.random.Generator(np.random.PCG64(7)).permutation(len(centre))[:k]].copy()
    for _ in range(rounds if len(centre) == k else 1):
        to = nearest(x, centre)
        n = np.bincount(to, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, to, x)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return centre


class Index:
    def __init__(self, x: np.ndarray, lists: int) -> None:
        self.dims = x.shape[1]
        self.parts = max(PARTS, -(-self.dims // WIDTH))
        self.width = -(-self.dims // self.parts)
        self.step = np.arange(self.parts) * CODES
        self.shift = x.mean(axis=0, dtype=np.float64)
        x = self.shifted(x)
        self.centre = kmeans(x, lists)
        some = x[: max(LEAST_FITTED, len(x) * PARTS // self.parts)]
        rest = self.residual(some, nearest(some, self.centre))
        self.books = [kmeans(rest[:, p], CODES) for p in range(self.parts)]

    def shifted(self, x: np.ndarray) -> np.ndarray:
        """Less the sample's mean: far from zero, squares of floats tell nothing of what lies between rows."""
        return (x - self.shift).astype(np.float32)

    def residual(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Rows by parts by width, padded with zeros."""
        out = np.zeros((len(x), self.parts * self.width), np.float32)
        out[:, : self.dims] = x - self.centre[to]
        return out.reshape(len(x), self.parts, self.width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = nearest(x, self.centre)
        rest = self.residual(x, to)
        return to, np.stack([nearest(rest[:, p], self.books[p]) for p in range(self.parts)], axis=1).astype(np.uint8)

    def decoded(self, to: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What lists and codes say of rows; distances to it are the sums of the tables."""
        rest = np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)
        return self.centre[to].astype(np.float64) + rest[:, : self.dims]

    def places(self, x: np.ndarray) -> np.ndarray:
        """Queries by lists: the place of each list in the order in which a query looks into them."""
        return np.argsort(np.argsort(distances(x, self.centre), axis=1, kind="stable"), axis=1)

    def probes(self, x: np.ndarray, k: int, recall: float, asked: int = 256) -> int:
        """How many lists hold that share of the k nearest of vectors of the sample, by their exact distances in it.

        The sample is thinner than all rows and its neighbours farther, so this is rather too many. Data without clusters needs
        more than half of the lists, clustered data a few.
        """
        if len(x) < 2:
            return len(self.centre)
        x = self.shifted(x)
        asked = min(asked, len(x))
        far = distances(x[:asked], x)
        far[np.arange(asked), np.arange(asked)] = np.inf
        near = np.argpartition(far, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
        to = nearest(x, self.centre)
        return 1 + int(np.quantile(np.take_along_axis(self.places(x[:asked]), to[near], 1), recall))

    def tables(self, x: np.ndarray, at: int) -> np.ndarray:
        """Asymmetric distance tables of queries in one list: queries by parts by codes."""
        rest = self.residual(x, np.full(len(x), at))
        out = np.full((len(x), self.parts, CODES), np.inf, np.float32)
        for p, book in enumerate(self.books):
            out[:, p, : len(book)] = distances(rest[:, p], book)
        return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector (as it is, for ranking) and n, its length, of the rows that may take part."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id is not null and vector is not null and size(vector) > 0")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)).withColumn("n", F.size("vector"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() :][: len(column) * (len(column[0]) if len(column) else 0)].reshape(len(column), -1).astype(np.float64) if len(column) else np.empty((0, 1))


def looked_for(rows: DataFrame, index: DataFrame, asked: DataFrame, fitted: Index, sent, probes: int, depth: int, k: int, recall: float) -> tuple[int, int]:
    """probes and depth, raised to what some queries need by their true neighbours. rows, asked: id, vector; index: list, id, code.

    Two passes over all rows: the first keeps in each task the nearest of each query, the second counts the codes that come before theirs.
    """
    some = asked.orderBy(F.xxhash64("id"), "id").limit(MEASURED).collect()
    ids, q = np.array([r["id"] for r in some], np.int64), fitted.shifted(np.array([r["vector"] for r in some], np.float64)).astype(np.float64)
    spark = rows.sparkSession
    asking = spark.sparkContext.broadcast((ids, q))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = asking.value
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            mine, x = batch.column(0).to_numpy(), matrix(batch.column(1)) - sent.value.shift
            far = np.where(mine[None] == ids[:, None], np.inf, distances(q, x))
            mine, which = np.broadcast_to(mine, far.shape), np.broadcast_to(np.arange(len(mine)), far.shape)
            cut = np.argpartition(far, min(k, far.shape[1]) - 1, axis=1)[:, :k]
            one = [np.take_along_axis(a, cut, 1) for a in (far, mine)] + [x[np.take_along_axis(which, cut, 1)]]
            best = one if best is None else [np.concatenate(a, axis=1) for a in zip(best, one, strict=True)]
            cut = np.argsort(best[0], axis=1, kind="stable")[:, :k]
            best = [np.take_along_axis(a, cut if a.ndim == 2 else cut[:, :, None], 1) for a in best]
        if best is None:
            return
        far, mine, x = best
        to, codes = sent.value.encode(x.reshape(-1, x.shape[2]).astype(np.float32))
        score = ((sent.value.decoded(to, codes) - np.repeat(q, far.shape[1], axis=0)) ** 2).sum(1)
        of = np.repeat(np.arange(len(q)), far.shape[1])
        ok = far.reshape(-1) < np.inf
        columns = (of.astype(np.int32), mine.reshape(-1), far.reshape(-1), to.astype(np.int32), score)
        yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in columns], names=["query", "id", "far", "list", "score"])

    near = rows.mapInArrow(kept, "query int, id long, far double, list int, score double")
    near = near.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy("far", "id"))).where(F.col("r") <= k).toPandas()
    if not len(near):
        return probes, depth
    of, to = near["query"].to_numpy(), near["list"].to_numpy()
    place = fitted.places(q)
    probes = max(probes, 1 + int(np.quantile(place[of, to], recall, method="higher")))
    wanted = spark.sparkContext.broadcast((place < probes, [near[of == j].sort_values("id") for j in range(len(q))]))

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = asking.value
        looks, near = wanted.value
        less = [np.zeros(len(n), np.int64) for n in near]
        for batch in batches:
            if not batch.num_rows:
                continue
            to, mine = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            far = distances(q, sent.value.decoded(to, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(to), -1)))
            for j, n in enumerate(near):
                here = np.flatnonzero(looks[j][to] & (mine != ids[j]))
                own, score = far[j][here], n["score"].to_numpy()
                ordered = np.sort(own)
                same = 1e-9 * (q[j] @ q[j] + score)  # equal codes come in the order of their ids
                less[j] += np.searchsorted(ordered, score - same)
                for t in range(len(n)):
                    less[j][t] += int((mine[here][np.abs(own - score[t]) <= same[t]] < n["id"].to_numpy()[t]).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(near)), [len(n) for n in near]).astype(np.int32)), pa.array(np.concatenate([n["id"].to_numpy() for n in near])), pa.array(np.concatenate(less))], names=["query", "id", "n"])

    counts = index.mapInArrow(before, "query int, id long, n long").groupBy("query", "id").agg(F.sum("n").alias("n")).toPandas().merge(near, on=["query", "id"])
    counts = counts[place[counts["query"], counts["list"]] < probes]
    return probes, max(depth, 1 + int(np.quantile(counts["n"], recall, method="higher")))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, depth: int = 256, recall: float = 0.98, max_sample: int = 131_072, max_lists: int = 16_384, shard_rows: int = 50_000, block_queries: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each usable query, the k nearest found."""
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x).cast("double")))
    sizes = rows.groupBy("n").agg(F.count("*").alias("rows"), F.max(largest).alias("largest"), F.percentile_approx(largest, 0.5).alias("common")).orderBy(F.col("rows").desc(), "n").first()
    dims, n = (sizes["n"], sizes["rows"]) if sizes else (0, 0)
    rows = rows.where(F.col("n") == dims).drop("n")
    asked = asked.where(F.col("n") == dims).groupBy("id").agg(F.min(F.struct(F.xxhash64("vector"), "vector"))["vector"].alias("vector"))
    floats, large = F.col("vector"), bool(n) and sizes["largest"] > LARGE
    if large:
        scale = 2.0 ** -math.ceil(math.log2(sizes["common"])) if sizes["common"] > LARGE else 1.0
        floats = F.transform("vector", lambda x: F.greatest(F.lit(-LARGE), F.least(F.lit(LARGE), x * F.lit(scale))))
    held = dict(rows.dtypes)["vector"]
    floats = floats.cast(held if held == "array<float>" and not large else "array<double>").alias("vector")
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = min(max_lists, math.isqrt(n))
    sample = min(max_sample, max(LEAST_SAMPLE, 8 * lists))
    drawn = np.array([r["vector"] for r in rows.select("id", floats).orderBy(F.xxhash64("id"), "id").limit(sample).toLocalIterator()], np.float64)
    fitted = Index(drawn, max(1, min(lists, len(drawn) // 8)))
    probes = fitted.probes(drawn, k, recall)
    sent = spark.sparkContext.broadcast(fitted)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                to, codes = sent.value.encode(sent.value.shifted(matrix(batch.column(1))))
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "id", "code"])

    index = written(rows.select("id", floats).mapInArrow(encode, "list int, id long, code binary"), "index")
    sizes = np.zeros(len(fitted.centre), np.int64)
    for r in index.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    if n > depth + 1 and asked.limit(1).count():
        probes, depth = looked_for(rows.select("id", floats), index, asked.select("id", floats), fitted, sent, probes, depth, k, recall)
        block_queries = max(32, min(block_queries, (block_queries << 8) // depth))
    shard_rows = min(shard_rows, max(LEAST_ROWS, -(-n // partitions(spark))))
    shards = np.maximum(1, -(-sizes // shard_rows))
    group, groups, held = np.zeros(len(sizes), np.int32), 0, 0
    for i, (size, parts) in enumerate(zip(sizes.tolist(), shards.tolist(), strict=True)):
        if held and (held + size > shard_rows or parts > 1):
            groups, held = groups + 1, 0
        group[i] = groups
        held += size
        if parts > 1:
            groups, held = groups + parts, 0
    dealt = spark.sparkContext.broadcast((sizes, shards, group))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, shards, group = dealt.value
        for batch in batches:
            out: list[list] = [[], [], []]
            x = sent.value.shifted(matrix(batch.column(1)))
            for i in range(batch.num_rows):
                order = np.argsort(distances(x[i : i + 1], sent.value.centre)[0], kind="stable")
                wanted = max(probes, 1 + int((np.cumsum(sizes[order]) < depth + 1).sum()))
                lists = np.sort(order[:wanted])
                to = np.concatenate([np.arange(group[a], group[a] + shards[a]) for a in lists.tolist()])
                for g in np.unique(to).tolist():
                    out[0].append(g)
                    out[1].append(i)
                    out[2].append(lists[(group[lists] <= g) & (g < group[lists] + shards[lists])].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), batch.column(0).take(pa.array(out[1], pa.int32())), pa.array(out[2], pa.binary())], names=["group", "query_id", "lists"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, shards, group = dealt.value
        for batch in batches:
            lists, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            to = group[lists] + mixed(ids.astype(np.uint64)) % shards[lists].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *batch.columns], names=["group", "list", "id", "code"])

    probed = written(asked.select("id", floats).mapInArrow(probe, "group int, query_id long, lists binary"), "probed")
    blocks = probed.groupBy("group").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("blocks"))
    left = index.mapInArrow(place, "group int, list int, id long, code binary").join(blocks, "group")
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = probed.join(blocks, "group").join(asked.select(F.col("id").alias("query_id"), floats), "query_id")
    right = right.select("group", "query_id", "vector", "lists", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"))

    def scan(codes: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if codes.num_rows and asked.num_rows:
            lists, ids = (codes[c].combine_chunks().to_numpy() for c in ("list", "id"))
            order = np.lexsort((ids, lists))
            lists, ids = lists[order], ids[order]
            code = np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(len(order), -1)[order]
            q, x = asked["query_id"].combine_chunks().to_numpy(), sent.value.shifted(matrix(asked["vector"].combine_chunks()))
            wanted = [np.frombuffer(b, np.int32) for b in asked["lists"].to_pylist()]
            here = np.unique(lists)
            edge = np.append(np.searchsorted(lists, here), len(lists))
            for lo in range(0, len(q), 32):
                some = wanted[lo : lo + 32]
                score = np.full((len(some), len(ids)), np.inf, np.float32)
                for at, a, e in zip(here.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    of = [j for j, w in enumerate(some) if at in w]
                    for j, table in zip(of, sent.value.tables(x[lo : lo + 32][of], at), strict=True):
                        score[j, a:e] = table.ravel()[code[a:e] + sent.value.step].sum(1)
                for j, own in enumerate(score):
                    most = min(len(ids), depth + 1)
                    best = np.flatnonzero((own <= np.partition(own, most - 1)[most - 1]) & (own < np.inf))
                    best = best[np.lexsort((ids[best], own[best]))][:most]
                    found[0].append(np.full(len(best), q[lo + j]))
                    found[1].append(ids[best])
                    found[2].append(own[best].astype(np.float64))
        return pa.table([pa.array(np.concatenate(f) if f else np.empty(0, t)) for f, t in zip(found, (np.int64, np.int64, np.float64), strict=True)], names=["query_id", "id", "near"])

    scanned = left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInArrow(scan, "query_id long, id long, near double")
    best = W.partitionBy("query_id")
    chosen = scanned.where("id <> query_id").withColumn("r", F.row_number().over(best.orderBy("near", "id"))).where(F.col("r") <= depth).select("query_id", "id").distinct()
    exact = F.sqrt(F.aggregate(F.zip_with("q", "vector", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
    if large:  # squares may be beyond doubles
        less, more = F.lit(2.0**-600), F.lit(2.0**600)
        scaled = F.sqrt(F.aggregate(F.zip_with("q", "vector", lambda a, b: F.pow(a * less - b * less, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)) * more
        exact = F.when(exact < float("inf"), exact).otherwise(scaled)
    met = chosen.join(rows, "id").join(asked.select(F.col("id").alias("query_id"), F.col("vector").alias("q")), "query_id")
    ranked = met.groupBy("query_id", F.col("id").alias("vec_id")).agg(F.min(exact).alias("score"))
    return ranked.withColumn("rank", F.row_number().over(best.orderBy("score", "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
