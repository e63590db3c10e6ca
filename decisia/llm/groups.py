"""Links inside groups of sets that are too large for a task.

References first: a few members of each group, drawn by hash, are compared with all its members, who are dealt over tasks by their bytes; members within the distance of
a link are linked, and those that no reference has reached go on to the next references, as long as a round links a fair share of them. So families of
near copies, however large, are joined in a pass or a few.

What is left are links between sets whose components differ. Every set x stands for its symmetric difference with one reference p of its group: differences keep all
distances, since (x ^ p) ^ (y ^ p) = x ^ y, and of texts from one template they hold just what is each text's own and what is p's own. Two sets are linked if
their differences differ in at most T = (100 - t) / (100 + t) (|x| + |y|) elements; if both together have no more than that, both are linked with p.
Otherwise they share one at least, and the first one that they share lies among the first T + 1 of each in any fixed order. The order
has common elements last, by their counts over all differences, so what p adds to everyone's comes last. Where the sets of an element meet, sizes and places must leave room
for the common part that a link needs; for very common elements that is first worked out by classes of size, place and component, so that classes without a partner never
meet. Texts of one template that differ by more than a link allows meet nowhere: T / 2 + 1 elements decide, and these are their own ones.
Pairs that are left, and that sketches of their sets don't exclude, are compared exactly.

Scale: the sets of these groups are a table in the shared folder; references go to its tasks, or, where they are too large for that, meet the members of their group in an exchange. Differences are worked
out where they are needed. The list of common elements is bounded (max_common); whatever is in it, results are the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisia.llm.buckets import Order, by_bucket, of_bucket
from decisia.llm.common import partitions, written
from decisia.llm.components import components
from decisia.llm.sketches import may_link, sketch
from decisia.llm.words import mixed

#: References of a group in a round; bytes of sets in a task; a round goes on if it linked this share; sets of an element that is counted; of one whose classes are worked out.
REFERENCES, TASK_BYTES, FAIR_SHARE, COMMON, HOT = 8, 16_000_000, 0.05, 16, 1000
BUCKET_ELEMENTS, BLOCK_BYTES, SHORT = 500_000, 8_000_000, 64
#: References, or ids, that are sent to every task.
SENT_BYTES = 48_000_000


def difference(x: np.ndarray, p: np.ndarray, label: int) -> np.ndarray:
    """Elements of just one of both, named anew for the group, in order."""
    return np.sort(mixed(np.setxor1d(x, p, assume_unique=True) + np.array([label], np.int64).view(np.uint64)))


def beside(members: DataFrame, references: DataFrame, work: Callable, schema: str, *more: str) -> DataFrame:
    """work(label, sigs, sets, references, more) of the members of a group, some at a time. members: label, sig, set and more; references: label, k, ref, set.

    References of SENT_BYTES in all go to every task, and members stay where they are; more references meet the members of their groups, dealt by their bytes, in an exchange.
    """
    spark = members.sparkSession
    some = members.select("label", "sig", "set", *more)

    def of(rows: pa.Table, refs: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("set")]
        return work(rows.column("label")[0].as_py(), rows.column("sig").combine_chunks(), sets, refs, *(rows.column(c).combine_chunks() for c in more))

    if (references.agg(F.sum(F.length("set"))).first()[0] or 0) <= SENT_BYTES:
        by_label: dict[int, list] = {}
        for r in references.orderBy("label", "k").toLocalIterator():
            by_label.setdefault(r["label"], []).append((r["ref"], bytes(r["set"])))
        sent = spark.sparkContext.broadcast(by_label)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                labels = batch.column(0).to_numpy()
                order = np.argsort(labels, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
                    if len(at):
                        refs = [(ref, np.frombuffer(x, np.uint64)) for ref, x in sent.value[int(labels[at[0]])]]
                        yield of(pa.Table.from_batches([batch]).take(pa.array(at)), refs)

        return some.mapInArrow(run, schema)
    salts = members.groupBy("label").agg(F.ceil(F.sum(F.length("set")) / TASK_BYTES).cast("int").alias("salts"))
    left = some.join(salts, "label").withColumn("salt", F.pmod(F.xxhash64("sig"), F.col("salts")).cast("int")).drop("salts")
    right = references.join(salts, "label").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(F.col("label").alias("l"), F.col("salt").alias("s"), "k", "ref", "set")

    def meet(rows: pa.Table, given: pa.Table) -> pa.Table:
        given = given.combine_chunks().sort_by("k")
        refs = [(r.as_py(), np.frombuffer(x.as_py(), np.uint64)) for r, x in zip(given["ref"], given["set"], strict=True)]
        names = [c.split()[0] for c in schema.split(", ")]
        return pa.Table.from_batches([of(rows, refs)]).select(names) if rows.num_rows else given.schema.empty_table().select([])

    return left.groupBy("label", "salt").cogroup(right.groupBy("l", "s")).applyInArrow(meet, schema)


def reached(members: DataFrame, per_cent: int) -> tuple[DataFrame, DataFrame]:
    """Links with references (a, b), and the first reference of each group (label, k, ref, set); members: label, sig, set."""

    def near(label: int, sigs: pa.Array, sets: list[np.ndarray], refs: list) -> pa.RecordBatch:
        out = []
        for x in sets:
            mine = []
            for ref, p in refs:
                if 100 * min(len(x), len(p)) >= per_cent * max(len(x), len(p)):
                    both = int((p[np.minimum(np.searchsorted(p, x), len(p) - 1)] == x).sum())
                    if (100 + per_cent) * both >= per_cent * (len(x) + len(p)):
                        mine.append(ref)
            out.append(mine)
        return pa.RecordBatch.from_arrays([sigs, pa.array(out, pa.list_(pa.int64()))], names=["sig", "near"])

    links = first = None
    left = members
    while True:
        drawn = left.groupBy("label", F.pmod(F.xxhash64("sig", F.lit(1)), F.lit(64)).alias("part")).agg(F.min(F.struct(F.xxhash64("sig").alias("h"), "sig")).alias("m"))
        drawn = drawn.groupBy("label").agg(F.slice(F.array_sort(F.collect_list("m")), 1, REFERENCES).alias("ms")).select("label", F.posexplode("ms").alias("k", "m"))
        drawn = written(drawn.select("label", "k", F.col("m.sig").alias("ref")), "drawn")
        own = drawn.count()
        named = drawn.select(F.col("label").alias("l"), "k", "ref")
        references = written(members.join(F.broadcast(named) if own * 32 <= SENT_BYTES else named, (F.col("label") == F.col("l")) & (F.col("sig") == F.col("ref"))).select("label", "k", "ref", "set"), "references")
        found = written(beside(left, references, near, "sig long, near array<long>").where(F.size("near") > 0), "reached")
        new = found.select(F.col("sig").alias("a"), F.explode("near").alias("b")).where("a <> b")
        links, first = (new, references.where("k = 0")) if links is None else (links.unionAll(new), first)
        hits = found.count()
        asked = left.count()
        if hits - own < FAIR_SHARE * asked or hits == asked:
            return links, first
        lost = found.select("sig")
        left = left.join(F.broadcast(lost) if hits * 16 <= SENT_BYTES else lost, "sig", "left_anti")


def common_elements(members: DataFrame, references: DataFrame, per_cent: int, most: int) -> Order:
    """The commonest elements of differences: those of more than COMMON.

    Elements of references that sets lack are counted whole; of a set's own elements all count if they are few, else those that come first by hash and a third more, as many as its window
    could hold.
    """
    total = members.agg(F.sum(F.length("set"))).first()[0] or 0
    buckets = max(1, total // (8 * BUCKET_ELEMENTS))

    def elements(label: int, sigs: pa.Array, sets: list[np.ndarray], refs: list) -> pa.RecordBatch:
        p, shift, kept = refs[0][1], np.array([label], np.int64).view(np.uint64), []
        lacked = np.zeros(len(p), np.int64)
        for x in sets:
            at = np.minimum(np.searchsorted(p, x), len(p) - 1)
            hit = p[at] == x
            lacked += 1
            lacked[at[hit]] -= 1
            own = np.sort(mixed(x[~hit] + shift))
            kept.append(own if len(own) <= SHORT else own[: int(reach(len(x), per_cent)) * 4 // 3 + 2])
        s, n = np.unique(np.concatenate(kept), return_counts=True)
        s, n = np.concatenate([s, mixed(p[lacked > 0] + shift)]), np.concatenate([n, lacked[lacked > 0]])
        rows = list(by_bucket((s >> np.uint64(8)) % np.uint64(buckets), s, n.astype(np.int64))) if len(s) else []
        whole = pa.Table.from_batches(rows).combine_chunks().to_batches() if rows else []
        return whole[0] if whole else pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary())], names=["bucket", "packed"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in of_bucket(batches):
            halves = [(blob[: len(blob) // 2], blob[len(blob) // 2 :]) for blob in blobs]
            s, at = np.unique(np.frombuffer(b"".join(x for x, _ in halves), np.uint64), return_inverse=True)
            n = np.bincount(at, np.frombuffer(b"".join(x for _, x in halves), np.int64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s[n > COMMON].view(np.int64)), pa.array(n[n > COMMON])], names=["shingle", "df"])

    dealt_out = beside(members, references, elements, "bucket long, packed binary").repartition(partitions(members.sparkSession), "bucket").sortWithinPartitions("bucket")
    found = dealt_out.mapInArrow(count, "shingle long, df long").orderBy(F.col("df").desc(), "shingle").limit(most).toArrow()
    return Order(found["shingle"].to_numpy().view(np.uint64), found["df"].to_numpy())


def reach(n, per_cent: int):
    """How many elements of a difference, in the order, a partner may lack, and one more; n: the size of the set itself."""
    return (100 - per_cent) * (n + n * 100 // per_cent + 1) // (100 + per_cent) + 1


def room(d1, d2, tail1, tail2, n1, n2, per_cent: int, least):
    """Whether sizes and places leave room for a link: for columns and for arrays."""
    most = (100 - per_cent) * (n1 + n2)
    return (2 * (100 + per_cent) * least(tail1, tail2) >= (100 + per_cent) * (d1 + d2) - most) & ((100 + per_cent) * (d1 - d2) <= most) & ((100 + per_cent) * (d2 - d1) <= most)


ENTRY = "s long, sig long, d long, tail long, n long, own long, hot boolean"


def entries(members: DataFrame, references: DataFrame, order, per_cent: int) -> DataFrame:
    """The window of each difference; members: label, sig, set, own (its component; null if it is alone)."""

    def window(label: int, sigs: pa.Array, sets: list[np.ndarray], refs: list, own: pa.Array) -> pa.RecordBatch:
        apart = [difference(x, refs[0][1], label) for x in sets]
        size, d = (np.fromiter(map(len, some), np.int64, len(some)) for some in (sets, apart))
        k = np.minimum(d, reach(size, per_cent))
        s = np.concatenate([order.value.first(x, m) for x, m in zip(apart, k.tolist(), strict=True)])
        row = np.repeat(np.arange(len(k)), k)
        tail = d[row] - (np.arange(len(s)) - np.repeat(np.cumsum(k) - k, k))
        hot = np.zeros(len(s), bool)
        listed, at = order.value.which(s)
        hot[listed] = order.value.count[at] > HOT
        columns = [pa.array(s.view(np.int64)), sigs.take(pa.array(row)), pa.array(d[row]), pa.array(tail), pa.array(size[row]), own.take(pa.array(row)), pa.array(hot)]
        return pa.RecordBatch.from_arrays(columns, names=["s", "sig", "d", "tail", "n", "own", "hot"])

    return beside(members, references, window, ENTRY, "own")


def classes_that_meet(hot: DataFrame, per_cent: int) -> DataFrame:
    """s, d, tail, n, own of very common elements that some other class, or another set of the class, leaves room for."""

    def meet(classes: pa.Table) -> pa.Table:
        classes = classes.combine_chunks().sort_by("d")
        d, tail, n, count = (classes[c].to_numpy() for c in ("d", "tail", "n", "count"))
        own = classes["own"].fill_null(0).to_numpy()
        alone = classes["own"].is_null().to_numpy()
        ok = np.zeros(len(d), bool)
        far = reach(n, per_cent)
        for lo in range(0, len(d), 256):
            some = slice(lo, lo + 256)
            a, b = np.searchsorted(d, [(d[some] - far[some]).min(), (d[some] + far[some]).max() + 1])
            fits = room(d[some, None], d[a:b], tail[some, None], tail[a:b], n[some, None], n[a:b], per_cent, np.minimum)
            fits &= (own[some, None] != own[a:b]) | (alone[some, None] != alone[a:b]) | (alone[some, None] & alone[a:b])
            same = np.arange(a, b)[None] == np.arange(lo, min(len(d), lo + 256))[:, None]
            fits &= ~same | ((count[some, None] > 1) & alone[some, None])
            ok[some] = fits.any(axis=1)
        return classes.filter(pa.array(ok)).select(["s", "d", "tail", "n", "own"])

    by = ["s", "d", "tail", "n", "own"]
    return hot.groupBy(*by).agg(F.count("*").alias("count")).groupBy("s").applyInArrow(meet, "s long, d long, tail long, n long, own long")


def candidates(window: DataFrame, per_cent: int) -> DataFrame:
    """a, b: sets of different components that meet at an element with room for a link."""
    hot = window.where("hot")
    kept = classes_that_meet(hot, per_cent)
    by = ["s", "d", "tail", "n"]
    hot = hot.alias("h").join(kept.alias("c"), [F.col(f"h.{c}") == F.col(f"c.{c}") for c in by] + [F.col("h.own").eqNullSafe(F.col("c.own"))], "left_semi")
    every = written(window.where("not hot").unionAll(hot), "window", "zstd")
    x, y = every.alias("x"), every.alias("y")
    fits = room(F.col("x.d"), F.col("y.d"), F.col("x.tail"), F.col("y.tail"), F.col("x.n"), F.col("y.n"), per_cent, F.least)
    apart = F.coalesce(F.col("x.own") != F.col("y.own"), F.lit(True))
    return x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.sig") < F.col("y.sig")) & apart & fits).select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b")).distinct()


def side_by_side(pairs: DataFrame, held: DataFrame, kind: str, judge: Callable, schema: str) -> DataFrame:
    """a, b, and judge(x, others) of the pairs; held: sig and an array as bytes, of numbers of this kind.

    What is held is dealt into blocks; a pair of blocks is a place to which just what its pairs need travels, each once.
    """
    data = held.columns[1]
    blocks = max(-(-(held.agg(F.sum(F.length(data))).first()[0] or 0) // BLOCK_BYTES), math.isqrt(2 * partitions(held.sparkSession)) + 1)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    placed = pairs.select("a", "b", (F.least(block("a"), block("b")) * blocks + F.greatest(block("a"), block("b"))).alias("place"))
    need = placed.select(F.col("a").alias("sig"), "place").union(placed.select("b", "place")).distinct()
    names = [c.split()[0] for c in schema.split(", ")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, {}
        for batch in batches:
            places, first, second = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            packed, out, i = batch.column(3), [], 0
            while i < batch.num_rows:
                if places[i] != now:
                    now, found = places[i], {}
                if second[i] is None:
                    found[int(first[i])] = np.frombuffer(packed[i].as_py(), kind)
                    i += 1
                    continue
                j, x, size = i + 1, found[int(first[i])], len(found[second[i]])
                while j < batch.num_rows and first[j] == first[i] and places[j] == now and second[j] is not None and size < 1 << 17:
                    size += len(found[second[j]])
                    j += 1
                out.append(np.stack([first[i:j], np.array(second[i:j], np.int64), *judge(x, [found[y] for y in second[i:j]])]))
                i = j
            columns = np.concatenate(out, axis=1) if out else np.empty((len(names), 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    travelling = held.join(need, "sig").select("place", F.col("sig").alias("a"), F.lit(None).cast("long").alias("b"), data)
    travelling = travelling.union(placed.select("place", "a", "b", F.lit(None).cast("binary")))
    ready = travelling.repartition(partitions(held.sparkSession), "place").sortWithinPartitions("place", F.col("b").isNotNull(), "a")
    return ready.mapInArrow(compare, schema)


def sketched(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs that sketches of their sets (sketches.py) don't exclude, so that sets travel for no others."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sketch(np.frombuffer(x.as_py(), np.uint64)) for x in batch.column(1)], pa.binary())], names=["sig", "sketch"])

    def judge(x: np.ndarray, others: list[np.ndarray]) -> list[np.ndarray]:
        width, near = np.fromiter(map(len, others), np.int64, len(others)), np.empty(len(others), np.int64)
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            near[at] = may_link(x[None], np.stack([others[k] for k in at.tolist()]), per_cent)
        return [near]

    sketches = written(sets.select("sig", "set").mapInArrow(made, "sig long, sketch binary"), "sketches")
    return side_by_side(pairs, sketches, "u1", judge, "a long, b long, near long").where("near = 1").select("a", "b")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, both, na, nb: sizes of the intersection and of the two sets."""

    def judge(x: np.ndarray, others: list[np.ndarray]) -> list[np.ndarray]:
        n, flat = np.fromiter(map(len, others), np.int64, len(others)), np.concatenate(others)
        hit = (x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat).astype(np.int64)
        return [np.add.reduceat(hit, np.cumsum(n) - n), np.full(len(n), len(x)), n]

    return written(side_by_side(pairs, sets, "u8", judge, "a long, b long, both long, na long, nb long"), "compared")


def wide_links(members: DataFrame, per_cent: int = 80, max_common: int = 1_000_000) -> DataFrame:
    """a, b: links that join all members (label, sig, set) that links join."""
    links, references = reached(members, per_cent)
    links = written(links, "links")
    own = components(links).select(F.col("v").alias("sig"), F.col("label").alias("own"))
    own = F.broadcast(own) if own.count() * 24 <= SENT_BYTES else own
    order = members.sparkSession.sparkContext.broadcast(common_elements(members, references, per_cent, max_common))
    window = written(entries(members.join(own, "sig", "left"), references, order, per_cent), "entries", "zstd")
    pairs = written(candidates(window, per_cent), "pairs")
    if not pairs.limit(1).count():
        return links
    pairs = written(sketched(pairs, members, per_cent), "pairs")
    seen = compared(pairs, members.select("sig", "set"))
    return links.unionAll(seen.where((100 + per_cent) * F.col("both") >= per_cent * (F.col("na") + F.col("nb"))).select("a", "b"))
