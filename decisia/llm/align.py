"""Alignment of two tokenizers over the same texts, with the corpus-wide strength of every pair of ids that it links.

A byte-level BPE (A) encodes a space and the text, a piece model (B), which adds that space itself, the text. Two pointers walk
the cumulative ends of both token lists; where both end, a group closes. All pairs of an A and a B token of one group are links. A pair of ids
counts in as many documents as hold it linked; a link is best for its A id (its B id) if no other pair of that id counts in more.

Texts are cut before a single space or line feed between two signs that aren't white space. Neither tokenizer has a token across such a place if
the files are of the usual kind (checked when they are opened; with others texts are taken whole), so groups don't cross it either, and what is known of
a segment is worked out once and looked up from then on.

One pass encodes: each task gives blocks of documents (BLOCK_CHARS, or one longer document) with the block's distinct pairs and in how many of its documents
each is held, so that shuffles see a pair once a block. Spark counts pairs over blocks, takes the maxima of both sides, joins both back to the blocks'
pairs, and each block adds up its documents. Blocks are a table in the shared folder.

Cases: null and empty texts have no tokens, nor have texts that a tokenizer doesn't give back byte for byte (a "▁" in the text, which B reads as a
space): zeros and an empty string. Special tokens' strings are ordinary text. Long texts are cut into sections at the same places, and only
their distinct pairs are held; a text without any space is one segment. In a group of many tokens the distinct ids of both sides are paired and weighted. Rows that repeat an id, or have none, are documents of their own; ties for the highest
count are all best; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisia.llm.common import text_of, written
from decisia.llm.encoding import PARTS, UNCUT, encoder

#: Signs of a section, signs of a block, segments kept by one worker and their longest, links of a group from which ids are paired by their counts.
SECTION_CHARS, BLOCK_CHARS = 1_000_000, 8_000_000
CACHED_SEGMENTS, CACHED_CHARS, WIDE = 200_000, 64, 4096

CUTS = regex.compile(r"(?<=\S)(?=[ \n]\S)")
SECTION = regex.compile(r"(?<=\S) (?=\S)")
SPACE_SIGN = "▁"

DOC = "struct<doc_id long, n_a long, n_b long, n_groups long, n_links long, n_pairs long, groups_sha256 string>"
BLOCK = f"block long, docs array<{DOC}>, a array<int>, b array<int>, held array<long>, place binary, times binary"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_pairs long, n_best_b long"


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The ends that both lists have: one merge of two sorted runs, in which the pointer behind goes on and a common end comes twice."""
    both = np.concatenate([ends_a, ends_b])
    both.sort(kind="stable")  # merges two runs
    return both[1:][both[1:] == both[:-1]]


#: What is known of a segment: numbers of A tokens, B tokens, groups and links, the groups as text, a pair of ids for each link, and, where
#: a group is wide, how often each pair is linked.
Segment = tuple[int, int, int, int, str, bytes, bytes | None]


class Aligner:
    """Both tokenizers and the segments met so far; None stands for a segment that a tokenizer doesn't give back."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = encoder(path_a, False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.n_b = self.b.vocab_size()
        self.bytes_a = [self._byte_level(self.a.tokenizer.id_to_token(i)) for i in range(self.a.tokenizer.get_vocab_size())]
        names = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.names = [f"{i}{sign}" for i in range(len(self.bytes_a)) for sign in ",|"] + [f"{i}{sign}" for i in range(self.n_b) for sign in ",;\n"]
        # B is cut before spaces and line feeds if no piece goes on behind another sign with one, and texts aren't rewritten
        inner = any("\n" in p or SPACE_SIGN in p.lstrip(SPACE_SIGN) for p in names)
        probe = "Ａ  ﬁ x\n\té "
        same = b"".join(self.bytes_b[i] for i in self.b.encode(probe)) == (" " + probe).encode()
        self.cuts = self.a.pieces is not None and not inner and same and [self.bytes_b[i] for i in self.b.encode("\n")] == [b" ", b"\n"]
        self.known: dict[str, Segment | None] = {}
        self.older: dict[str, Segment | None] = {}

    def _byte_level(self, entry: str) -> bytes:
        back = _signs()
        return bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()

    def segments(self, text: str) -> list[str]:
        """The text behind its space, cut; each segment starts with a space or a line feed."""
        whole = " " + text
        if not self.cuts:
            return [whole]
        if "\n\n" in whole or any(x in whole for x in UNCUT):
            return CUTS.split(whole)
        return whole.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]

    def learn(self, segments: set[str]) -> None:
        """What isn't known yet of these, in one call of either library for all that can stand in one text."""
        if len(self.known) > CACHED_SEGMENTS:
            self.older, self.known = self.known, {}
        new = []
        for s in segments:
            if s not in self.known:
                if s in self.older:
                    self.known[s] = self.older[s]
                else:
                    new.append(s)
        if self.cuts:
            alone = [s for s in new if len(s) < 2 or s[1].isspace() or s[-1].isspace()]
            self._learn(sorted(set(new).difference(alone)))
            new = alone
        for s in new:
            self._learn([s])

    def _learn(self, new: list[str]) -> None:
        """Segments that are the cuts of their concatenation."""
        if not new:
            return
        text = "".join(new)
        data = text.encode()
        a = np.frombuffer(b"".join(map(self.a.pieces.__getitem__, PARTS.findall(text))), "<u4") if self.cuts else next(self.a.encode([text]))
        # behind a line feed, a token of its own, B adds no space; the one that it adds before goes with it
        b = np.array(self.b.encode("\n" + text)[2:] if self.cuts else self.b.encode(text[1:]), np.int64)
        if b"".join([self.bytes_a[i] for i in a.tolist()]) != data or b"".join([self.bytes_b[i] for i in b.tolist()]) != data:
            if len(new) == 1:
                self.known[new[0]] = None
            else:
                for s in new:
                    self._learn([s])
            return
        a = a.astype(np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = merged(ends_a, ends_b)
        stops = np.cumsum(np.fromiter((len(s.encode()) for s in new), np.int64, len(new)))
        last = np.searchsorted(ends, stops)  # the last group of each segment
        group_a, group_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        said = self._said(a, b, group_a, group_b, in_a, in_b, last)
        links = in_a * in_b
        wide = np.flatnonzero(links >= WIDE)
        paired = in_b.copy()
        paired[wide] = 0
        each = paired[group_a]  # links of each A token, in the order of A
        of_a = np.repeat(np.arange(len(a)), each)
        of_b = np.repeat(first_b[group_a] - (np.cumsum(each) - each), each) + np.arange(len(of_a))
        pairs = a[of_a] * self.n_b + b[of_b]
        narrow = links.copy()
        narrow[wide] = 0
        upto = [np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], last + 1])] for x in (in_a, in_b, np.ones(len(ends), np.int64), links, narrow)]
        counts = [np.diff(x).tolist() for x in upto[:4]]
        cut, raw = (upto[4] * 8).tolist(), pairs.tobytes()
        some = [raw[lo:hi] for lo, hi in zip(cut, cut[1:])]
        times: list[bytes | None] = [None] * len(new)
        for k in np.unique(np.searchsorted(last, wide)).tolist():
            of_k = [g for g in wide.tolist() if (last[k - 1] if k else -1) < g <= last[k]]
            some[k], times[k] = self._weighted(some[k], [(a[first_a[g] : first_a[g] + in_a[g]], b[first_b[g] : first_b[g] + in_b[g]]) for g in of_k])
        self.known.update(zip(new, zip(*counts, said, some, times, strict=True), strict=True))

    def _said(self, a, b, group_a, group_b, in_a, in_b, last) -> list[str]:
        """The groups of each segment as text: the tokens of both sides in their order, each with the sign that follows it."""
        before_a, before_b = np.cumsum(in_a), np.cumsum(in_b) - in_b
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + before_b[group_a]] = a * 2 + np.append(group_a[1:] != group_a[:-1], True)
        ends = np.append(group_b[1:] != group_b[:-1], True)
        signs = ends.astype(np.int64)
        signs[np.cumsum(in_b)[last] - 1] = 2
        order[np.arange(len(b)) + before_a[group_b]] = 2 * len(self.size_a) + b * 3 + signs
        return "".join([self.names[i] for i in order.tolist()]).split("\n")[:-1]

    def _weighted(self, narrow: bytes, groups: list[tuple[np.ndarray, np.ndarray]]) -> tuple[bytes, bytes]:
        """Distinct pairs with their numbers, where groups are wide: distinct ids of both sides and the products of their numbers."""
        pairs = [np.frombuffer(narrow, np.int64)]
        weights = [np.ones(len(pairs[0]), np.int64)]
        for a, b in groups:
            (ids_a, n_a), (ids_b, n_b) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
            pairs.append(np.add.outer(ids_a * self.n_b, ids_b).ravel())
            weights.append(np.outer(n_a, n_b).ravel())
        keys, times = summed(np.concatenate(pairs), np.concatenate(weights))
        return keys.tobytes(), times.tobytes()

    def forget(self, segments: set[str]) -> None:
        for s in segments:
            if len(s) > CACHED_CHARS:
                self.known.pop(s, None)


@functools.cache
def _signs() -> dict[str, int]:
    """The signs that byte-level vocabularies write bytes with."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, str]]]:
    """Documents of some megabytes at a time; a long one comes alone."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            if rows and size + len(text) > SECTION_CHARS or len(rows) >= 10_000:
                yield rows
                rows, size = [], 0
            rows.append((doc_id, text))
            size += len(text)
    if rows:
        yield rows


def sections(text: str, cuts: bool) -> Iterator[str]:
    """A long text in parts that tokens don't cross, without the space between them."""
    lo = 0
    while cuts and len(text) - lo > SECTION_CHARS:
        cut = SECTION.search(text, lo + SECTION_CHARS)
        if cut is None:
            break
        yield text[lo : cut.start()]
        lo = cut.end()
    yield text[lo:]


class Block:
    """Documents of a block, and their pairs (the document's number and the pair, in one long) with how often each is linked."""

    def __init__(self, size: int) -> None:
        self.size = size  # ids of A times ids of B
        self.docs: list[tuple] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.chars = self.loose = 0

    def add(self, rows: list[tuple[int | None, str]], al: Aligner) -> None:
        """Documents of a chunk, or one long document whose sections are learnt one after another."""
        if len(rows) == 1:
            self._add(*rows[0], ([s] for s in sections(rows[0][1], al.cuts)), al)
            return
        cut = [al.segments(text) if text else [] for _, text in rows]
        met = set().union(*cut)
        al.learn(met)
        for (doc_id, text), segments in zip(rows, cut, strict=True):
            self._add(doc_id, text, [segments], al)
        al.forget(met)

    def _add(self, doc_id: int | None, text: str, parts: Iterable[list[str]], al: Aligner) -> None:
        at, digest, sums, keys, times = len(self.docs), None, [0] * 4, [], []
        for part in parts if text else ():
            met: set[str] = set()
            if isinstance(parts, list):
                segments = part
            else:
                segments = al.segments(part[0])
                met = set(segments)
                al.learn(met)
            found = [al.known[s] for s in segments]
            al.forget(met)
            if None in found:
                digest, sums, keys, times = None, [0] * 4, [], []
                break
            n_a, n_b, n_groups, n_links, said, pairs, weights = zip(*found, strict=True)
            sums = [x + sum(y) for x, y in zip(sums, (n_a, n_b, n_groups, n_links), strict=True)]
            said = ";".join(said).encode()
            if digest is None:
                digest = hashlib.sha256(said)
            else:
                digest.update(b";" + said)
            keys.append(np.frombuffer(b"".join(pairs), np.int64))
            if any(w is not None for w in weights):
                times.append(np.concatenate([np.ones(len(p) // 8, np.int64) if w is None else np.frombuffer(w, np.int64) for p, w in zip(pairs, weights, strict=True)]))
            else:
                times.append(np.ones(len(keys[-1]), np.int64))
            if len(keys) > 8:  # a long document holds its distinct pairs only
                k, t = summed(np.concatenate(keys), np.concatenate(times))
                keys, times = [k], [t]
        for k, t in zip(keys, times, strict=True):
            self.keys.append(k + at * self.size)
            self.times.append(t)
            self.loose += len(k)
        self.docs.append((doc_id, *sums, digest.hexdigest() if digest else ""))
        self.chars += len(text)
        if self.loose > 1_000_000:
            self.settle()

    def settle(self) -> None:
        if self.loose:
            keys, times = summed(np.concatenate(self.keys), np.concatenate(self.times))
            self.keys, self.times, self.loose = [keys], [times], 0

    def row(self, number: int, n_b: int) -> pa.RecordBatch:
        self.settle()
        keys = self.keys[0] if self.keys else np.empty(0, np.int64)
        times = self.times[0] if self.times else np.empty(0, np.int64)
        n_pairs = np.bincount(keys // self.size, minlength=len(self.docs))
        pairs, place, held = np.unique(keys % self.size, return_inverse=True, return_counts=True)
        docs = [dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), d, strict=True)) | {"n_pairs": int(n)} for d, n in zip(self.docs, n_pairs, strict=True)]
        fields = pa.struct([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_pairs", "groups_sha256")])
        columns = [
            pa.array([number], pa.int64()),
            pa.array([docs], pa.list_(fields)),
            pa.array([(pairs // n_b).astype(np.int32)], pa.list_(pa.int32())),
            pa.array([(pairs % n_b).astype(np.int32)], pa.list_(pa.int32())),
            pa.array([held], pa.list_(pa.int64())),
            pa.array([place.astype("<u4").tobytes()], pa.binary()),
            pa.array([times.astype("<i8").tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["block", "docs", "a", "b", "held", "place", "times"])


def blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of aligned documents, as a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        size = len(al.bytes_a) * al.n_b
        block = Block(size)
        for rows in chunks(batches):
            block.add(rows, al)
            if block.chars >= BLOCK_CHARS or len(block.docs) >= 100_000:
                yield block.row(number, al.n_b)
                block, number = Block(size), number + 1
        if block.docs:
            yield block.row(number, al.n_b)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return written(rows.mapInArrow(run, BLOCK), "aligned", "zstd")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, docs (documents that hold the pair linked), best_a, best_b (whether no other pair of the id has more), as a table in the shared folder."""
    links = aligned.select(F.inline(F.arrays_zip("a", "b", "held")))
    counts = written(links.groupBy("a", "b").agg(F.sum("held").alias("docs")), "pairs")
    top_a, top_b = (counts.groupBy(F.col(c).alias(f"_{c}")).agg(F.max("docs").alias(f"_top_{c}")) for c in ("a", "b"))
    both = counts.join(top_a, F.col("a") == F.col("_a")).join(top_b, F.col("b") == F.col("_b"))
    return both.select("a", "b", "docs", (F.col("docs") == F.col("_top_a")).alias("best_a"), (F.col("docs") == F.col("_top_b")).alias("best_b"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: its tokens, groups and links, how many links are best for their A id and for their B id, the sum of links' counts, and the digest of its groups."""
    aligned = blocks(docs, path_a, path_b, id_col, text_col)
    links = aligned.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("i", "pair")).select("block", "i", "pair.a", "pair.b")
    counted = links.join(pair_counts(aligned), ["a", "b"]).select("block", "i", "docs", "best_a", "best_b")

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("i").to_numpy(), kind="stable")
        docs_of, best = right.column("docs").to_numpy()[order], [right.column(c).to_numpy()[order].astype(np.int64) for c in ("best_a", "best_b")]
        row = left.to_pylist()[0]
        place, times = np.frombuffer(row["place"], "<u4"), np.frombuffer(row["times"], "<i8")
        ends = np.cumsum([d["n_pairs"] for d in row["docs"]])
        per_link = [times * x[place] for x in (best[0], docs_of, best[1])] if len(place) else [np.empty(0, np.int64)] * 3
        upto = [np.concatenate([[0], np.cumsum(x)]) for x in per_link]
        n_best, count_sum, n_best_b = (u[ends] - u[ends - [d["n_pairs"] for d in row["docs"]]] for u in upto)
        columns = {n: [d[n] for d in row["docs"]] for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs")} | {"n_best": n_best, "count_sum": count_sum, "n_best_b": n_best_b}
        names = [x.split()[0] for x in OUT.split(", ")]
        return pa.table([pa.array(columns[n], pa.string() if n == "groups_sha256" else pa.int64()) for n in names], names=names)

    packed = aligned.select(F.col("block").alias("own"), "docs", "place", "times")
    return packed.groupBy("own").cogroup(counted.groupBy("block")).applyInArrow(settle, OUT)


def groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups themselves: doc_id, group (its number from 0), a, b (ids). Documents without tokens have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(path_a, path_b)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (a, b) in enumerate(grouped(text, al)):
                    rows.append((doc_id, k, a, b))
            for lo in range(0, len(rows), 50_000):
                some = list(zip(*rows[lo : lo + 50_000], strict=True))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(some, kinds, strict=True)], names=["doc_id", "group", "a", "b"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, group long, a array<int>, b array<int>")


def grouped(text: str, al: Aligner) -> Iterable[tuple[list[int], list[int]]]:
    found = []
    for section in sections(text, al.cuts) if text else ():
        segments = al.segments(section)
        al.learn(set(segments))
        found += [al.known[s] for s in segments]
        al.forget(set(segments))
        if None in found:
            return ()
    said = ";".join([s[4] for s in found])
    return ([[int(i) for i in side.split(",")] for side in g.split("|")] for g in said.split(";")) if found else ()
