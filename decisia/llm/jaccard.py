"""Exact Jaccard join of word-shingle sets in a metric space.

Distance is one minus Jaccard; r, the distance of a link, is 0.2 where 80 per cent is asked. Almost all pairs of documents
are at distance 1, where pivots that are documents tell nothing and Voronoi cells of them separate nothing. So the division has two levels.

First level, prefix windows: the pivots are single shingles, in one fixed order with common ones last. A set's home is its first
shingle; a set within r of it misses at most n - ceil(0.8 n) of its shingles and so has its home among the next ones, and the set is
replicated to just so many regions after its home. In a region, two sets can be linked only if their sizes and the places of the
region's shingle in them leave room for the common share that a link needs (their first common shingle is the region where this
holds). Pairs of a small region pass that test one by one, and then counts of shingles in classes (a mapping that shrinks the
symmetric difference, so what it puts beyond r is beyond r; sketches.py), more classes for longer texts. A large region is divided into classes of size and place; classes that
can hold linked sets, directly or by others, stay together, all others fall apart. So texts from one template that differ
by too much don't meet, however many they are.

Second level, Voronoi regions: what hangs together travels, each set once, to one task, which joins it recursively: documents as
pivots, every member compared with each; members within r of a pivot are linked; all are dealt into the Voronoi cells of their
nearest pivots and replicated to each cell j with d(x, p_j) <= d(x, home) + 2 r; cells whose members are one component already
are done, others are divided again, small ones are joined pair by pair, and a group whose cells don't halve its pairs is joined by prefix windows in
the order of its own counts.

Groups of too many members or shingles for a task go another way (groups.py): members are compared with references in turn, and what isn't joined then is found by prefix
windows of their differences from one reference, which keep all distances and are small where texts come from one template.

Scale: copies (equal sets) are one point. The order puts shingles of more sets than a leaf holds last, by their counts over all
documents; the list of them is bounded (max_common, the commonest), and whatever is in it, results are the same. Regions of
very common ones are dealt over as many buckets as their counts ask for, and their classes are worked out over all of them. Sets
travel only for documents in some candidate pair, found by a Bloom filter of bounded size on the second reading. Components are found by joins.

Identity: sets are told apart by digests of 128 bits. Working names are the first 64; names that two sets share (at most a few
hundred among 10^11 sets) are found over all documents and give way to the other 64. Shingles are told apart by 64 bits, made of 64 bits of each word whatever its letters and
length: two unequal shingles pass for equal with a probability of 2^-64, so a pair of sets of a thousand shingles each is counted wrong with one of 10^-13.

Cases: null and empty texts have no shingles and link with nothing; a text of fewer than five words is one shingle; very long
texts are sets like others, hashed in blocks; rows that repeat an id and text are one point; ties are settled by least ids; rows
without an id take no part and have no component; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisia.llm.buckets import Order, by_bucket, dealt, of_bucket
from decisia.llm.common import partitions, text_of, written
from decisia.llm.components import components
from decisia.llm.groups import wide_links
from decisia.llm.sketches import near_enough, sketch
from decisia.llm.words import Words, mixed, runs

SHINGLE, CLASSES = 5, 64
CHUNK_BYTES, BUCKET_ROWS, SALTED_SETS = 4_000_000, 100_000, 20_000
LEAF, PIVOTS, DIVIDED, GROUP_SETS, GROUP_SHINGLES = 16, 8, 96, 20_000, 2_000_000
FILTER_BITS = 1 << 26
#: Shingles of a set all of which are counted.
SHORT = 64


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and sorted distinct shingle hashes, a few megabytes at a time."""
    ids, texts, size = [], [], 0

    def made() -> tuple[list, list[np.ndarray]]:
        words = Words(texts, lower=True)
        h, first = words.hashes(), words.first.tolist()
        r, out = runs(h, SHINGLE), []
        for a, b in zip(first, first[1:], strict=False):
            if b - a >= SHINGLE:
                out.append(np.unique(r[a : b - SHINGLE + 1]))
            elif b > a:
                out.append(np.frombuffer(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
        return ids, out

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(i)
            texts.append(t.as_py().encode())
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield made()
                ids, texts, size = [], [], 0
    if texts:
        yield made()


def signature(x: np.ndarray) -> tuple[int, int]:
    found = np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), "<i8")
    return int(found[0]), int(found[1])


def named(x: np.ndarray, clashes: frozenset) -> int:
    """A set's name: the first half of its digest, the other half where two sets share the first."""
    name, other = signature(x)
    return other if name in clashes else name


def new_points(batches: Iterator[pa.RecordBatch], clashes: frozenset) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Names and sets, the first of equal ones in a batch; no empty sets."""
    for _, found in sets(batches):
        points = {named(x, clashes): x for x in found if len(x)}
        yield list(points), list(points.values())


def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First reading: a row a document, with its set's size, signature and, once a batch of documents, class counts."""
    for ids, some in sets(batches):
        sigs, seen, sketches = [], set(), []
        for x in some:
            sigs.append(signature(x) if len(x) else (None, None))
            sketches.append(None)
            if len(x) and sigs[-1] not in seen:
                seen.add(sigs[-1])
                sketches[-1] = sketch(x)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in some], pa.int64()), *(pa.array([x[k] for x in sigs], pa.int64()) for k in (0, 1)), pa.array(sketches, pa.binary())], names=["doc_id", "n", "sig", "other", "sketch"])


def meeting(n: np.ndarray, tail: np.ndarray, count: np.ndarray, per_cent: int) -> np.ndarray:
    """Parts of classes (size of a set, how many of its shingles come from the region's on) that links may join; -1: of no part.

    Two sets whose first common shingle is the region's share no more than the lesser tail.
    """
    part = np.full(len(n), -1, np.int64)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        less, more = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
        return others[(100 * less >= per_cent * more) & ((100 + per_cent) * np.minimum(tail[others], tail[i]) >= per_cent * (less + more))]

    left, parts = np.arange(len(n)), 0
    while len(left):
        first, left = int(left[0]), left[1:]
        waiting, mine = [first], 1
        while waiting and len(left):
            found = near(waiting.pop(), left)
            left = np.setdiff1d(left, found, assume_unique=True)
            part[found] = parts
            waiting += found.tolist()
            mine += len(found)
        if mine > 1 or count[first] > 1 and len(near(first, np.array([first]))):
            part[first] = parts
            parts += 1
    return part


class Group:
    """Sets that may be near to each other, joined exactly; links join what isn't joined yet."""

    def __init__(self, sets: list[np.ndarray], per_cent: int) -> None:
        self.sets, self.t = sets, per_cent
        self.n = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = (np.concatenate(sets) >> np.uint64(20)).astype(np.int64) & (CLASSES - 1)
        self.classes = np.bincount(np.repeat(np.arange(len(sets)) * CLASSES, self.n) + flat, minlength=len(sets) * CLASSES).reshape(-1, CLASSES)
        self.root, self.links = np.arange(len(sets)), []

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of one set with others."""
        mine, flat = self.sets[i], np.concatenate([self.sets[j] for j in others.tolist()])
        hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
        return np.add.reduceat(hit.astype(np.int64), np.cumsum(self.n[others]) - self.n[others])

    def link(self, i: int, others: np.ndarray, both: np.ndarray) -> None:
        near = others[(100 + self.t) * both >= self.t * (self.n[i] + self.n[others])]
        for j in near.tolist():
            if self.root[i] != self.root[j]:
                self.root[self.root == self.root[j]] = self.root[i]
                self.links.append((i, j))

    def windows(self, members: np.ndarray) -> None:
        """Pairs by prefix windows in the order of counts among the members, rare ones first."""
        n, t = self.n[members], self.t
        owner = np.repeat(np.arange(len(members)), n)
        _, at, count = np.unique(np.concatenate([self.sets[j] for j in members.tolist()]), return_inverse=True, return_counts=True)
        order = np.lexsort((at, count[at], owner))
        place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        shingle = at[order]
        ahead = (place < np.repeat(n + -(-n * t // -100) + 1, n)) & (count[shingle] > 1)
        owner, place, shingle = owner[ahead], place[ahead], shingle[ahead]
        order = np.argsort(shingle, kind="stable")
        owner, place, shingle = owner[order], place[order], shingle[order]
        cut = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1])) if len(shingle) else np.empty(0, np.int64)
        for lo, hi in zip(cut.tolist(), np.append(cut, len(shingle))[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            kinds, of, many = np.unique(np.stack([n[owner[lo:hi]], n[owner[lo:hi]] - place[lo:hi]]), axis=1, return_inverse=True, return_counts=True)
            of = of.reshape(-1)
            part = meeting(*kinds, many, t)[of]
            for k in np.unique(part[part >= 0]).tolist():
                some = np.flatnonzero(part == k)
                self.pairs(members[owner[lo:hi][some]], kinds[1][of[some]])

    def pairs(self, members: np.ndarray, tail: np.ndarray | None = None) -> None:
        """Every pair that isn't excluded by sizes or class counts, or joined already."""
        order = np.argsort(self.n[members], kind="stable")
        members = members[order]
        sizes = self.n[members]
        tail = sizes if tail is None else tail[order]
        for k, i in enumerate(members[:-1].tolist()):
            last = int(np.searchsorted(sizes, sizes[k] * 100 // self.t, side="right"))
            rest = members[k + 1 : last]
            rest = rest[(self.root[rest] != self.root[i]) & ((100 + self.t) * np.minimum(tail[k], tail[k + 1 : last]) >= self.t * (sizes[k] + sizes[k + 1 : last]))]
            if len(rest):
                far = np.abs(self.classes[rest] - self.classes[i]).sum(1)
                rest = rest[(100 + self.t) * far <= (100 - self.t) * (self.n[i] + self.n[rest])]
            for lo in range(0, len(rest), 64):
                some = rest[lo : lo + 64]
                some = some[self.root[some] != self.root[i]]
                if len(some):
                    self.link(i, some, self.shared(i, some))

    def divide(self, members: np.ndarray) -> list[np.ndarray]:
        """Voronoi cells with their windows. The first pivot is the member whose shingles most others have, each next one the farthest from those before."""
        flat = np.concatenate([self.sets[j] for j in members.tolist()])
        _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
        often = np.add.reduceat(count[at], np.cumsum(self.n[members]) - self.n[members]) / self.n[members]
        pivot, d = int(np.argmax(often)), []
        for _ in range(PIVOTS):
            both = self.shared(int(members[pivot]), members)
            self.link(int(members[pivot]), members, both)
            d.append(1 - both / (self.n[members[pivot]] + self.n[members] - both))
            nearest = np.min(d, axis=0)
            pivot = int(np.argmax(nearest))
            if nearest[pivot] == 0:
                break
        window = np.min(d, axis=0) + 2 * (1 - self.t / 100) + 1e-9
        return [members[far <= window] for far in d]

    def solve(self) -> list[tuple[int, int]]:
        waiting = [np.arange(len(self.sets))]
        while waiting:
            members = waiting.pop()
            if len(members) <= DIVIDED:
                self.pairs(members)
                continue
            found = [cell for cell in self.divide(members) if len(np.unique(self.root[cell])) > 1]
            if 2 * sum(len(cell) ** 2 for cell in found) <= len(members) ** 2:  # each division halves the pairs at least
                waiting += found
            else:
                self.windows(members)
        return self.links


def common_shingles(rows: DataFrame, per_cent: int, buckets: int, most: int, clashes: frozenset) -> Order:
    """Shingles that more sets than a leaf holds have among their first ones by hash, and a third more, or anywhere in a set of SHORT or fewer: counted over all documents.

    Short texts are where templates are most: with all their common shingles last, their own come first and classes of place tell them apart.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, points in new_points(batches, clashes):
            if points:
                s = np.concatenate([x if len(x) <= SHORT else x[: (len(x) - -(-len(x) * per_cent // 100)) * 4 // 3 + 2] for x in points])
                yield from by_bucket((s >> np.uint64(8)) % np.uint64(buckets), s)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in of_bucket(batches):
            found, n = np.unique(np.frombuffer(b"".join(blobs), np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[n > LEAF].view(np.int64)), pa.array(n[n > LEAF])], names=["shingle", "df"])

    found = dealt(rows, deal).mapInArrow(count, "shingle long, df long").orderBy(F.col("df").desc(), "shingle").limit(most).toArrow()
    return Order(found["shingle"].to_numpy().view(np.uint64), found["df"].to_numpy())


#: What a region gives. PAIR: x, y may be linked. HANGS: y with x. LOOSE: set y, of z shingles, p of them before the region's, in the region x, which is dealt over several buckets.
PAIR, HANGS, LOOSE = range(3)


def region_rows(rows: DataFrame, order, per_cent: int, buckets: int, clashes: frozenset) -> DataFrame:
    """Second reading: each set goes to its home and the pivots of its window. kind, x, y, z, p."""

    def dealt_over(s: np.ndarray) -> np.ndarray:
        """Over how many buckets the region of each shingle goes."""
        out = np.ones(len(s), np.int64)
        listed, at = order.value.which(s)
        out[listed] = -(-order.value.count[at] // SALTED_SETS)
        return out

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sigs, points in new_points(batches, clashes):
            if not points:
                continue
            n = np.fromiter(map(len, points), np.int64, len(points))
            k = n - -(-n * per_cent // 100) + 1
            s = np.concatenate([order.value.first(x, m) for x, m in zip(points, k.tolist(), strict=True)])
            sig = np.repeat(np.array(sigs, np.int64), k)
            place = np.minimum(np.arange(len(s)) - np.repeat(np.cumsum(k) - k, k), 65535).astype(np.uint16)
            size = np.repeat(n.astype(np.uint32), k)
            to = (s >> np.uint64(8)) % np.uint64(buckets)
            over = dealt_over(s)
            hot = np.flatnonzero(over > 1)
            to[hot] = mixed(s[hot] + mixed(sig[hot].view(np.uint64)) % over[hot].astype(np.uint64)) % np.uint64(buckets)
            yield from by_bucket(to, s, sig, size, place)

    def join(blobs: list[bytes]) -> list[np.ndarray]:
        parts = []
        for blob in blobs:
            m = len(blob) // 22
            parts.append((np.frombuffer(blob, np.uint64, m), np.frombuffer(blob, np.int64, m, 8 * m), np.frombuffer(blob, np.uint32, m, 16 * m), np.frombuffer(blob, np.uint16, m, 20 * m)))
        s, sig, size, place = (np.concatenate(c) for c in zip(*parts, strict=True))
        by = np.argsort(s, kind="stable")
        run = s[by]
        alone = np.ones(len(run), bool)
        alone[1:] &= run[1:] != run[:-1]
        alone[:-1] &= run[:-1] != run[1:]
        by = by[~alone | (dealt_over(run) > 1)]
        by = by[np.lexsort((sig[by], size[by], s[by]))]
        s, sig, size, place = s[by], sig[by], size[by].astype(np.int64), place[by].astype(np.int64)
        if not len(s):
            return []
        fresh = np.ones(len(s), bool)
        fresh[1:] = (s[1:] != s[:-1]) | (sig[1:] != sig[:-1])
        s, sig, size, place = s[fresh], sig[fresh], size[fresh], place[fresh]
        cut = np.flatnonzero(s[1:] != s[:-1]) + 1
        a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(s)]])
        loose = dealt_over(s[a]) > 1
        many = (b - a > LEAF) | loose
        out = []

        def put(kind: int, x, y: np.ndarray, z=0, p=0) -> None:
            out.append(np.stack([np.broadcast_to(np.asarray(v, np.int64), y.shape) for v in (kind, x, y, z, p)]))

        # leaves: each member with the next ones, which are no smaller
        small = np.repeat(~many, b - a)
        end = np.repeat(b, b - a)
        for step in range(1, int((b - a)[~many].max(initial=1))):
            i = np.flatnonzero(small & (np.arange(len(s)) + step < end))
            if not len(i):
                break
            j = i + step
            most = np.minimum(size[i] - place[i], size[j] - place[j])
            ok = (100 * size[i] >= per_cent * size[j]) & ((100 + per_cent) * most >= per_cent * (size[i] + size[j]))
            i, j = i[ok], j[ok]
            put(PAIR, np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j]))
        for lo, hi, apart in zip(a[many].tolist(), b[many].tolist(), loose[many].tolist(), strict=True):
            if apart:
                put(LOOSE, s[lo : lo + 1].view(np.int64)[0], sig[lo:hi], size[lo:hi], place[lo:hi])
                continue
            kinds, of, count = np.unique(np.stack([size[lo:hi], size[lo:hi] - place[lo:hi]]), axis=1, return_inverse=True, return_counts=True)
            part = meeting(*kinds, count, per_cent)[of.reshape(-1)]
            for k in np.unique(part[part >= 0]).tolist():
                some = lo + np.flatnonzero(part == k)
                mine = sig[some]
                put(HANGS, mine[np.argmin(mixed(mine.view(np.uint64).copy()))], mine)  # the same one in all regions where they meet
        return out

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in of_bucket(batches):
            out = join(blobs)
            columns = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.empty((5, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "x", "y", "z", "p"])

    return dealt(rows, deal).mapInArrow(regions, "kind long, x long, y long, z long, p long")


def gathered(found: DataFrame, per_cent: int) -> DataFrame:
    """Rows of the regions that were dealt over several buckets: their classes are a row each, whatever the number of members."""
    loose = written(found.where(F.col("kind") == LOOSE).select("x", "y", "z", "p").distinct(), "loose")

    def divide(classes: pa.Table) -> pa.Table:
        x, z, p, count = (classes[c].combine_chunks().to_numpy() for c in ("x", "z", "p", "count"))
        part = meeting(z, z - p, count, per_cent)
        return pa.table([pa.array(c[part >= 0]) for c in (x, z, p, part)], names=["x", "z", "p", "part"])

    classes = loose.groupBy("x", "z", "p").count().groupBy("x").applyInArrow(divide, "x long, z long, p long, part long")
    members = loose.join(classes, ["x", "z", "p"]).select(F.xxhash64("x", "part").alias("x"), "y")
    by = F.struct(F.xxhash64("y").alias("h"), "y")
    least = members.groupBy("x", F.pmod("y", F.lit(64)).alias("salt")).agg(F.min(by).alias("m")).groupBy("x").agg(F.min("m")["y"].alias("first"))
    zero = F.lit(0).cast("long")
    hangs = members.join(least, "x").select(F.lit(HANGS).alias("kind"), F.col("first"), "y", zero, zero)
    return found.where(F.col("kind") != LOOSE).unionAll(hangs)


def sets_of(need: DataFrame, rows: DataFrame, clashes: frozenset) -> DataFrame:
    """sig, set of the signatures in need, and of a few others: by a Bloom filter of bounded size."""
    spark = rows.sparkSession

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(FILTER_BITS >> 3, np.uint8)
        for batch in batches:
            for at in cells(batch.column(0).to_numpy()):
                np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k in np.flatnonzero(held.reshape(-1, 4096).any(axis=1)).tolist():
            yield pa.RecordBatch.from_pydict({"k": [k], "bits": [held[4096 * k : 4096 * k + 4096].tobytes()]})

    wanted = np.zeros(FILTER_BITS >> 3, np.uint8)
    for row in need.select("sig").mapInArrow(bits, "k long, bits binary").toLocalIterator():
        wanted[4096 * row["k"] : 4096 * row["k"] + 4096] |= np.frombuffer(row["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(wanted)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sigs, points in new_points(batches, clashes):
            of = np.array(sigs, np.int64)
            ok = np.ones(len(of), bool)
            for at in cells(of):
                ok &= (sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            i = np.flatnonzero(ok).tolist()
            for lo in range(0, len(i), 256):
                yield pa.RecordBatch.from_arrays([pa.array(of[i[lo : lo + 256]]), pa.array([points[j].tobytes() for j in i[lo : lo + 256]], pa.binary())], names=["sig", "set"])

    # copies in other batches bring the same set: one of each goes on, by the exchange that the next join needs anyhow
    return rows.mapInArrow(some, "sig long, set binary").groupBy("sig").agg(F.first("set").alias("set"))


def joined_groups(group: DataFrame, rows: DataFrame, per_cent: int, clashes: frozenset) -> DataFrame:
    """a, b: links of groups (sig, label), each solved in one task."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def links() -> pa.RecordBatch:
            sigs = list(held)
            found = Group(list(held.values()), per_cent).solve() if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([sigs[i] for i, _ in found], pa.int64()), pa.array([sigs[j] for _, j in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for label, sig, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if label != now and held:
                    yield links()
                    held = {}
                now = label
                held[sig] = np.frombuffer(packed.as_py(), np.uint64)
        if held:
            yield links()

    travelling = sets_of(group, rows, clashes).join(group, "sig").select("label", "sig", "set")
    return written(travelling.repartition(partitions(rows.sparkSession), "label").sortWithinPartitions("label", "sig").mapInArrow(solve, "a long, b long"), "links")


def cells(sigs: np.ndarray) -> list[np.ndarray]:
    h = mixed(sigs.astype(np.int64).view(np.uint64).copy())
    return [((h >> np.uint64(shift)) & np.uint64(FILTER_BITS - 1)).astype(np.int64) for shift in (0, 18, 36)]


def near_components(docs: DataFrame, per_cent: int = 80, max_common: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    first = written(rows.mapInArrow(narrow, "doc_id long, n long, sig long, other long, sketch binary"), "narrow")
    shingles = first.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(shingles * (1 - per_cent / 100) / BUCKET_ROWS))
    rows = rows.where("doc_id is not null")
    merged = (F.min("doc_id").alias("id"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    points = written(first.where("sig is not null").groupBy("sig").agg(*merged, (F.min("other") != F.max("other")).alias("clash")), "points")
    clashes = frozenset(r["sig"] for r in points.where("clash").select("sig").collect())  # expected number: sets squared / 2^65
    if clashes:
        first = first.withColumn("sig", F.when(F.col("sig").isin(*clashes), F.col("other")).otherwise(F.col("sig")))
        points = written(first.where("sig is not null").groupBy("sig").agg(*merged), "points")
    points = points.where("id is not null")
    order = spark.sparkContext.broadcast(common_shingles(rows, per_cent, buckets, max_common, clashes))
    found = written(region_rows(rows, order, per_cent, buckets, clashes), "regions")
    if found.where(F.col("kind") == LOOSE).limit(1).count():
        found = written(gathered(found, per_cent), "regions")
    sketches = points.where("sketch is not null").select("sig", "sketch")
    pair = F.col("x").alias("a"), F.col("y").alias("b")
    pairs = written(near_enough(found.where(F.col("kind") == PAIR).select(*pair).distinct(), sketches, per_cent), "pairs")
    together = pairs.union(found.where(F.col("kind") == HANGS).select(*pair)).where("a <> b").distinct()
    group = components(together).select(F.col("v").alias("sig"), "label")
    size = group.join(points.select("sig", "n"), "sig").groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
    wide = size.where((F.col("n") > GROUP_SHINGLES) | (F.col("m") > GROUP_SETS)).select("label")
    wide = written(group.join(wide, "label"), "wide")
    any_wide = wide.limit(1).count() > 0
    links = joined_groups(group.join(wide, "sig", "left_anti") if any_wide else group, rows, per_cent, clashes)
    if any_wide:
        members = written(sets_of(wide, rows, clashes).join(wide, "sig").select("label", "sig", "set"), "members")
        links = links.union(wide_links(members, per_cent, max_common))
    links = links.join(points.select(F.col("sig").alias("a"), F.col("id").alias("ia")), "a").join(points.select(F.col("sig").alias("b"), F.col("id").alias("ib")), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    labels = components(links)
    of = points.join(labels, points["id"] == labels["v"], "left").select("sig", F.coalesce("label", "id").alias("component"))
    with_id = first.select("doc_id", F.col("n").alias("n_shingles"), "sig").join(of, "sig", "left")
    return with_id.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def drop_near(docs: DataFrame, per_cent: int = 80, broadcast_mb: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay: of each component that with the least id, and those without an id, with all their columns."""
    found = written(near_components(docs, per_cent, id_col=id_col, text_col=text_col), "components")
    lost = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    lost = F.broadcast(lost) if lost.count() * 16 <= broadcast_mb << 20 else lost
    return docs.join(lost, docs[id_col].cast("long") == lost["_id"], "left_anti")
