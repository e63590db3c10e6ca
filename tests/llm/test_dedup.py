"""Exact, near and substring dedup against plain versions, on edge cases and on the small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from decisia.llm import exact, groups, jaccard, sketches, substrings
from decisia.llm.common import table
from tests.llm.conftest import texts_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for n, i in enumerate(sorted(ids, key=lambda i: (i is None, i))):
            first = i == keep and n == 0
            out[i, keep, len(ids), first, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("filters", [{}, {"max_filter_mb": 2**-20}, {"cells_per_row": 1}])
def test_exact_groups(spark, edge, sf, filters, monkeypatch):
    """The filter whole, in many slices of a few bytes, and so small that it tells little."""
    monkeypatch.setattr(exact, "UNFOLDED", 1 if filters else exact.UNFOLDED)
    for docs in (edge, table(spark, sf, "documents") if not filters else edge):
        got = exact.exact_groups(docs, **filters).collect()
        assert Counter(tuple(r) for r in got) == plain_groups(texts_of(docs))


def test_exact_slices(spark, sf, monkeypatch):
    """Many slices, one of them hot: a job whatever their number, and the same groups."""
    rows = table(spark, sf, "documents").select("doc_id", "text").unionAll(spark.range(1000, 1400).select("id", F.lit("one hot text")))
    asked = []
    plain = exact.probed_by_slice
    monkeypatch.setattr(exact, "probed_by_slice", lambda *a: asked.append(a[3]) or plain(*a))
    monkeypatch.setattr(exact, "BLOCK_CELLS", 64)
    got = exact.exact_groups(rows, max_filter_mb=2**-14).collect()
    assert asked[0] > 10 and Counter(tuple(r) for r in got) == plain_groups(texts_of(rows))


def test_exact_empty_and_columns(edge, none):
    assert exact.exact_groups(none).count() == 0
    assert exact.drop_copies(none).count() == 0
    kept = exact.drop_copies(edge)
    assert kept.columns == edge.columns
    want = Counter(i for (i, _, _, first, _), n in plain_groups(texts_of(edge)).items() for _ in range(n) if first)
    assert Counter(r["doc_id"] for r in kept.collect()) == want


def plain_components(rows, per_cent=80):
    sets = []
    for i, t in rows:
        w = WORDS.findall(t.translate(LOWER))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = {i: i for i, _ in sets if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            if i is not None and j is not None and x and y:
                both = len(x & y)
                if 100 * both >= per_cent * (len(x) + len(y) - both):
                    a, b = sorted((top(i), top(j)))
                    parent[b] = a
    return Counter((i, len(x), None if i is None else top(i)) for i, x in sets)


@pytest.mark.parametrize("leaf", [16, 2])
def test_jaccard(spark, edge, sf, leaf, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 50_000 if leaf == 2 else jaccard.CHUNK_BYTES)
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", 300 if leaf == 2 else jaccard.GROUP_SHINGLES)
    for docs in (edge, table(spark, sf, "documents")):
        assert Counter(tuple(r) for r in jaccard.near_components(docs).collect()) == plain_components(texts_of(docs))


def test_jaccard_large_group(spark, monkeypatch):
    """A group in which no document is near to all: members beyond a pivot's ball are found by cells."""
    monkeypatch.setattr(jaccard, "LEAF", 4)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    base = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join([*base[:150], *(f"v{i // 4}_{k}" if i % 4 == 0 and k < i // 8 else w for k, w in enumerate(base[150:]))])) for i in range(80)]
    rows += [(100 + i, " ".join([*(f"z{j}" for j in range(3 * i)), *base[3 * i :]])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in jaccard.near_components(docs).collect()) == plain_components(rows)


def families(r, n_families, copies, words, apart, core):
    """Texts of one template: families of near copies, each `apart` words from the template, and single ones."""
    base = [f"t{k}" for k in range(words)]
    out = []
    for f in range(n_families):
        own = list(base)
        for k in r.sample(range(words), apart):
            own[k] = f"f{f}_{k}"
        for c in range(r.choice(copies)):
            one = list(own)
            for k in r.sample(range(words), r.randint(0, core)):
                one[k] = f"c{f}_{c}_{k}"
            out.append(" ".join(one))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_jaccard_wide_groups(spark, monkeypatch, seed):
    """Groups that no task takes whole: references, rounds, differences, windows, very common elements, salted tasks; texts of several templates, chains, and sizes far apart."""
    for name, value in (("GROUP_SETS", 5), ("LEAF", 3 + seed)):
        monkeypatch.setattr(jaccard, name, value)
    for name, value in (("REFERENCES", 1 + seed), ("TASK_BYTES", (400, 3000, 10**7, 10**5)[seed]), ("COMMON", 2 + seed), ("HOT", (3, 10, 1000, 5)[seed]), ("SENT_BYTES", (groups.SENT_BYTES, 100)[seed % 2]), ("SHORT", (64, 5)[seed // 2]), ("BUCKET_ELEMENTS", 50), ("BLOCK_BYTES", (8000, 10**7, 300, 10**5)[seed]), ("FAIR_SHARE", (0.05, 0.5, 0.05, 1.0)[seed])):
        monkeypatch.setattr(groups, name, value)
    r = random.Random(seed)
    texts = families(r, 12, [1, 1, 2, 9], 120, 6 + seed, 2) + families(r, 30, [1], 60, 2, 0) + families(r, 5, [6], 200, 3, 4)
    texts += [" ".join([*(f"z{j}" for j in range(3 * i)), *(f"t{k}" for k in range(3 * i, 120))]) for i in range(25)]
    texts += [" ".join(f"t{k}" for k in range(n)) for n in range(40, 120, 3)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(x) for x in jaccard.near_components(docs).collect()) == plain_components(rows)


def test_jaccard_long_template(spark):
    """Thousands of long texts of one template, five words apart from it each, too much for any link: one group by what hangs together, and no link in it but the planted ones."""
    import time

    r, base, rows = random.Random(2), [f"b{k}" for k in range(200)], []
    for i in range(6000):
        own = list(base)
        for k in (r.randrange(5 + 38 * j, 34 + 38 * j) for j in range(5)):
            own[k] = f"n{i}_{k}"
        rows.append((i, " ".join(own)))
    rows += [(10_000 + i, rows[i][1] + " more") for i in range(0, 6000, 100)]
    start = time.perf_counter()
    got = {x["doc_id"]: x["component_id"] for x in jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: i if i < 10_000 else i - 10_000 for i, _ in rows} and time.perf_counter() - start < 240


def test_jaccard_empty_and_columns(edge, none):
    assert jaccard.near_components(none).count() == 0
    assert jaccard.drop_near(none).count() == 0
    assert jaccard.drop_near(edge).columns == edge.columns


def plain_substrings(rows):
    where = {}
    for i, t in rows:
        w = t.encode().split()
        for k in range(len(w) - 19):
            where.setdefault(b" ".join(w[k : k + 20]), []).append((-1 if i is None else i, t, k))
    out = Counter()
    for i, t in rows:
        w, covered = t.encode().split(), set()
        for k in range(len(w) - 19):
            places = where[b" ".join(w[k : k + 20])]
            me = (-1 if i is None else i, k)
            if any((p[0], p[2]) < me for p in places if p[1] == t or p[0] != me[0]):
                covered.update(range(k, k + 20))
        kept = b" ".join(x for k, x in enumerate(w) if k not in covered)
        out[i, len(w), len(covered), hashlib.sha256(kept).hexdigest(), kept.decode()] += 1
    return out


@pytest.mark.parametrize(("chunk", "held", "windows"), [(None, None, None), (3_000, None, None), (3_000, 2_000, 10_000), (3_000, 2_000, 100)])
def test_substrings(spark, edge, sf, chunk, held, windows, monkeypatch):
    """Also with many chunks, with buckets that go on with digests, and with buckets that give their windows off."""
    if chunk:
        monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(substrings, "BUCKET_BYTES", 20_000)
    if held:
        monkeypatch.setattr(substrings, "HELD_BYTES", held)
        monkeypatch.setattr(substrings, "HELD_WINDOWS", windows)
    for docs in (edge, table(spark, sf, "documents")):
        assert Counter(tuple(r) for r in substrings.drop_repeats(docs).collect()) == plain_substrings(texts_of(docs))


def test_substrings_hot_passage(spark, monkeypatch):
    """One passage in every document, between words of its own: its minimisers are dealt window by window."""
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 20_000)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, " ".join([*(f"a{i}x{k}" for k in range(25)), passage, *(f"b{i}x{k}" for k in range(25))])) for i in range(300)]
    got = substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert Counter(tuple(r) for r in got.collect()) == plain_substrings(rows)


def test_substrings_empty(none):
    assert substrings.drop_repeats(none).count() == 0


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_components(spark, most, monkeypatch):
    """Paths, stars, repeated and turned links, whichever way."""
    import random

    from decisia.llm import components

    monkeypatch.setattr(components, "ONE_TASK", most)
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(30)] + [(300 + r.randrange(60), 300 + r.randrange(60)) for _ in range(35)] + [(-5, 7), (7, -5), (9, 9)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((top(a), top(b)))
            parent[high] = low
    got = {row["v"]: row["label"] for row in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in list(parent)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_templates(spark):
    """Texts of one template that differ in too many words are no group, however many; those that differ in few are one."""
    rows = [(i, f"thank you for your recent order with us number n{i}") for i in range(30_000)]
    rows += [(100_000 + i, " ".join(["dear customer", *(f"c{k}" for k in range(60)), f"m{i}", *(f"d{k}" for k in range(60))])) for i in range(3_000)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert all(got[i] == (i if i < 100_000 else 100_000) for i, _ in rows)


@pytest.mark.parametrize("salted", [5, 20_000])
def test_jaccard_salted_regions(spark, salted, monkeypatch):
    """Common shingles dealt over several buckets: their classes are worked out over all of them."""
    monkeypatch.setattr(jaccard, "SALTED_SETS", salted)
    monkeypatch.setattr(jaccard, "LEAF", 3)
    monkeypatch.setattr(jaccard, "GROUP_SETS", 60)
    base = [f"w{k}" for k in range(80)]
    rows = [(i, " ".join([*base[: 80 - i % 9], *(f"x{i % 5}_{k}" for k in range(i % 4)), *base[:i % 3]])) for i in range(150)]
    rows += [(1000 + i, " ".join([*base[:20], f"u{i}", *base[20:40], f"v{i}"])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(tuple(r) for r in jaccard.near_components(docs).collect()) == plain_components(rows)


def test_jaccard_names_that_clash(spark, edge, monkeypatch):
    """Sets that share the first half of their digest are told apart by the other."""
    real = jaccard.signature
    monkeypatch.setattr(jaccard, "signature", lambda x: (real(x)[0] % 3, real(x)[1]))
    docs = edge.where("doc_id is null or doc_id <> 12")
    assert Counter(tuple(r) for r in jaccard.near_components(docs).collect()) == plain_components(texts_of(docs))


def test_group_windows():
    """Prefix windows inside a group find what pairs one by one find."""
    import random

    import numpy as np

    r = random.Random(8)
    sets = []
    for _ in range(60):
        core = r.sample(range(4000), 120)
        for _ in range(r.randint(1, 8)):
            sets.append(np.unique(np.array([x for x in core if r.random() > 0.06] + r.sample(range(5000, 9000), r.randint(0, 15)), np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    roots = []
    for way in ("pairs", "windows", "solve"):
        group = jaccard.Group(sets, 80)
        getattr(group, way)(*(() if way == "solve" else (np.arange(len(sets)),)))
        first = {}
        roots.append([first.setdefault(x, i) for i, x in enumerate(group.root.tolist())])
    assert roots[0] == roots[1] == roots[2] and len(set(roots[0])) < len(sets)


def test_jaccard_many_short_templates(spark, monkeypatch):
    """Short texts of one template never form a group, whichever of their common shingles come first by hash."""
    monkeypatch.setattr(jaccard, "GROUP_SETS", 500)
    calls = []
    monkeypatch.setattr(jaccard, "wide_links", lambda *a: calls.append(a))
    rows = [(i, f"thank you for your recent order with us number n{i}") for i in range(4_000)]
    got = jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got) and len(got) == len(rows) and not calls


def twins(n):
    """Two words of 2^n letters that polynomial hashes modulo a power of two don't tell apart."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_long_words_that_differ(spark):
    """Words differ in one letter, in their order of letters, or in length, before and behind the place from which they are digested."""
    t, u = twins(10)
    rest = " ".join(f"w{i}" for i in range(19))
    pairs = [(t, u), ("x" * 63 + "y", "x" * 63 + "z"), ("x" * 64 + "y", "x" * 64 + "z"), ("x" * 64, "x" * 65), ("y" + "x" * 200, "z" + "x" * 200), ("ab" * 40, "ba" * 40), ("é" * 40, "è" * 40)]
    for k, (a, b) in enumerate(pairs):
        docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}")], "doc_id long, text string")
        assert [r["n_removed"] for r in substrings.drop_repeats(docs).orderBy("doc_id").collect()] == [0, 0, 20], k
    short = spark.createDataFrame([(10 * k + j, f"{w} k{k} b c d") for k, two in enumerate(pairs) for j, w in enumerate((*two, two[0]))], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_components(short).collect()}
    assert got == {10 * k + j: 10 * k + (1 if j == 1 else 0) for k in range(len(pairs)) for j in range(3)}


def test_hashes_of_words_are_spread():
    from decisia.llm.words import Words

    r = random.Random(4)
    words = {"".join(r.choice("ab") for _ in range(r.choice([5, 12, 63, 64, 65, 130]))) for _ in range(20_000)} | set(twins(12))
    h = Words([" ".join(sorted(words)).encode()]).hashes()
    assert len(np.unique(h)) == len(words) and abs(np.unpackbits(h.view(np.uint8)).mean() - 0.5) < 0.01
    assert (Words([w.encode() for w in sorted(words)]).hashes() == h).all()


def test_jaccard_long_texts_apart(spark, monkeypatch):
    """Long texts that share a passage and are far from each other: only the planted copy brings sets to a group."""
    r = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, " ".join([*(f"w{r.randrange(10**6)}" for _ in range(4000)), passage])) for i in range(12)]
    rows += [(20, rows[3][1] + " and some more")]
    asked = []
    plain = jaccard.joined_groups
    monkeypatch.setattr(jaccard, "joined_groups", lambda group, *a: asked.append(group.count()) or plain(group, *a))
    assert Counter(tuple(x) for x in jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == plain_components(rows)
    assert asked == [2]


def test_jaccard_wide_group_of_long_texts(spark, monkeypatch):
    """In a group too large for a task, sets travel for pairs that sketches leave, not for all that share an element."""
    r = np.random.default_rng(3)
    sets = [r.integers(0, 1 << 64, 4000, dtype=np.uint64) for _ in range(12)]
    for x, y in zip(sets, sets[1:], strict=False):
        y[:200] = x[200:400]
    sets.append(np.append(sets[5][:-100], r.integers(0, 1 << 64, 150, dtype=np.uint64)))
    members = spark.createDataFrame([(1, k, np.unique(x).tobytes()) for k, x in enumerate(sets)], "label long, sig long, set binary")
    asked = []
    plain = groups.compared
    monkeypatch.setattr(groups, "compared", lambda pairs, held: asked.append((groups.candidates.found.count(), pairs.count())) or plain(pairs, held))
    met = groups.candidates

    def candidates(*a):
        candidates.found = met(*a)
        return candidates.found

    monkeypatch.setattr(groups, "candidates", candidates)
    monkeypatch.setattr(groups, "REFERENCES", 1)
    links = {tuple(sorted(x)) for x in groups.wide_links(members).collect()}
    assert links == {(5, 12)}
    assert asked and asked[0][0] > 5 and asked[0][1] <= 2
    for x in sets:  # the bound holds where sketches are of unlike widths, and where a count ends at the limit
        assert sketches.may_link(*(np.frombuffer(sketches.sketch(y), np.uint8)[None] for y in (x, np.append(x, x[:900] + np.uint64(1 << 20)))), 80)
    full = np.arange(300, dtype=np.uint64)
    assert sketches.may_link(*(np.frombuffer(sketches.sketch(y), np.uint8)[None] for y in (full, full[:240])), 80).all()
