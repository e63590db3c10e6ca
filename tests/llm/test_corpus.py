"""Tokenizer alignment, source divergence and language profiles against plain versions of their definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from decisia.llm import align, divergence, language, queries
from decisia.llm.common import table
from decisia.llm.encoding import tokenizer_path

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
LIBRARY_A, LIBRARY_B = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
LIBRARY_A.encode_special_tokens = True
SIGNS = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {chr(b): b for b in SIGNS} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in SIGNS)}


def bytes_a(i):
    return bytes(BYTES[c] for c in LIBRARY_A.id_to_token(i))


def bytes_b(i):
    p = LIBRARY_B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if LIBRARY_B.is_byte(i) else p.replace("▁", " ").encode()


def plain_groups(text):
    """Lists of A and B ids between ends that both have."""
    if not text:
        return []
    whole = (" " + text).encode()
    sides = [(LIBRARY_A.encode(" " + text, add_special_tokens=False).ids, bytes_a), (LIBRARY_B.encode(text), bytes_b)]
    if any(b"".join(map(f, ids)) != whole for ids, f in sides):
        return []
    ends = [list(np.cumsum([len(f(i)) for i in ids])) for ids, f in sides]
    out, low = [], [0, 0]
    for end in sorted(set(ends[0]) & set(ends[1])):
        high = [e.index(end) + 1 for e in ends]
        out.append(tuple(ids[lo:hi] for (ids, _), lo, hi in zip(sides, low, high, strict=True)))
        low = high
    return out


def plain_alignment(rows):
    each = [(i, plain_groups(text)) for i, text in rows]
    links = [[(a, b) for x, y in groups for a in x for b in y] for _, groups in each]
    held = Counter(pair for some in links for pair in set(some))
    top_a, top_b = defaultdict(int), defaultdict(int)
    for (a, b), n in held.items():
        top_a[a], top_b[b] = max(top_a[a], n), max(top_b[b], n)
    out = []
    for (i, groups), some in zip(each, links, strict=True):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        counts = (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(some))
        best = (sum(held[p] == top_a[p[0]] for p in some), sum(held[p] for p in some))
        out.append((i, *counts, *best, hashlib.sha256(said.encode()).hexdigest() if groups else "", len(set(some)), sum(held[p] == top_b[p[1]] for p in some)))
    return out


def test_segments_cut_nothing():
    """Random strings of all that could matter to either tokenizer, in one aligner that remembers segments."""
    al, r = align.Aligner(A, B), random.Random(1)
    assert al.cuts
    parts = ["a", " ", "\n", "  ", "\t", "the", " of", "é", "日", "<s>", "</s>", "<|endoftext|>", ".", ",", "'s", "\0", "▁", "\x1c", "　", "​", "1", "ing", "-----", "<0x41>", "é", "\U0001f600"]
    for _ in range(1500):
        text = "".join(r.choices(parts, k=r.randint(0, 20)))
        assert [(list(x), list(y)) for x, y in align.grouped(text, al)] == plain_groups(text), text


def test_alignment_small(spark, edge, none):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()] + [(50, "x▁y"), (51, "<s> <|endoftext|> <0x41>"), (52, "the the the"), (52, "the the the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = align.align(docs, A, B)
    assert Counter(map(tuple, got.collect())) == Counter(plain_alignment(rows))
    assert not align.align(none, A, B).count() and not align.groups(none, A, B).count()
    groups = defaultdict(list)
    for r in align.groups(edge.where("doc_id is not null").dropDuplicates(["doc_id"]), A, B).orderBy("doc_id", "group").collect():
        groups[r["doc_id"]].append((r["a"], r["b"]))
    assert groups[5] == plain_groups(rows[5][1]) and 0 not in groups and 1 not in groups


def test_alignment_query(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op11_token_alignment(spark, sf).collect())) == Counter(plain_alignment(rows))


def test_blocks_sections_and_wide_groups(spark, monkeypatch):
    """Tiny blocks and sections, and groups whose links are weighted, give what whole ones give."""
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["the", "onering", "und", "reanthe,", "x1"]) for _ in range(r.randint(1, 120)))) for i in range(40)]
    rows += [(90, "ab" * 300 + " " + "ba" * 200 + " end"), (91, ""), (92, "a" * 500)]
    al = align.Aligner(A, B)
    for wide, section, segments, cached in ((2, 100, 20, 5), (4096, 50, 1000, 64)):
        for name, value in (("WIDE", wide), ("SECTION_CHARS", section), ("CACHED_SEGMENTS", segments), ("CACHED_CHARS", cached)):
            monkeypatch.setattr(align, name, value)
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
        block, held = align.Block(len(al.bytes_a) * al.n_b), Counter()
        for some in align.chunks(iter([batch])):
            block.add(some, al)
        out = block.row(7, al.n_b).to_pylist()[0]
        for (i, text), doc in zip(rows, out["docs"], strict=True):
            want = plain_alignment([(i, text)])[0]
            assert (doc["doc_id"], doc["n_a"], doc["n_b"], doc["n_groups"], doc["n_links"], doc["groups_sha256"], doc["n_pairs"]) == (*want[:5], *want[7:9])
            held.update({(a, b) for x, y in plain_groups(text) for a in x for b in y})
        assert {(a, b): n for a, b, n in zip(out["a"], out["b"], out["held"], strict=True)} == held
        times = np.frombuffer(out["times"], "<i8")
        assert times.sum() == sum(d["n_links"] for d in out["docs"])


def plain_audit(rows, min_docs, top, smoothing=5, scale=10**9):
    """Straight from the definition, with Python's integers."""
    words = [(lang or "", source or "", re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {x for x, _, _ in words}:
        here = [(s, w) for x, s, w in words if x == lang]
        held = Counter(t for _, w in here for t in set(w))
        kept = [t for t, n in held.items() if n >= min_docs]
        counts = {s: Counter() for s, _ in here}
        for s, w in here:
            counts[s].update(t for t in w if held[t] >= min_docs)
        whole = sum(counts.values(), Counter())
        shares = lambda c: {t: 1 + scale * (c[t] + smoothing) // (sum(c.values()) + smoothing * len(kept)) for t in kept}
        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return out


def test_audit_small(spark, edge, none, monkeypatch):
    r = random.Random(5)
    vocabulary = ["The", "the", "über", "straße", "x1y", "日本", "rare", "É", "zoë's"]
    rows = [(r.choice(["en", "de", None, ""]), r.choice(["a", "b", "Z", "é", None]), " ".join(r.choices(vocabulary, [9, 9, 5, 4, 3, 2, 0.2, 1, 1], k=r.randint(0, 30)))) for _ in range(150)]
    rows += [("fr", "only", None), ("fr", "other", "un deux"), ("xx", "a", ""), *[("en", "a", "copy of one text")] * 40]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("doc_id", F.monotonically_increasing_id())
    want = Counter(plain_audit(rows, 4, 3))
    assert Counter(map(tuple, divergence.audit(docs, min_docs=4, top=3).collect())) == want
    monkeypatch.setattr(divergence, "TILE", 2)
    assert Counter(map(tuple, divergence.audit(docs.repartition(3), min_docs=4, top=3).collect())) == want
    with pytest.raises(ValueError):
        divergence.audit(docs, max_groups=3)
    odd = [tuple(r) for r in edge.select("lang", "source", "text").collect()]
    assert Counter(map(tuple, divergence.audit(edge, min_docs=2).collect())) == Counter(plain_audit(odd, 2, 50))
    assert divergence.audit(none).count() == 0


def test_audit_blocks_and_bounds(monkeypatch):
    text = "Ab c, ünï " * 40
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 16)
    assert [w for some in divergence.words_in_blocks(text) for w in some] == re.sub(r"[^a-z\x80-\U0010ffff]+", " ", text.lower()).encode().split()
    monkeypatch.setattr(divergence, "HELD_WORDS", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(["l"] * 6), pa.array(["s", "t"] * 3), pa.array(["a b c d", "a a", "e", "a", "b b b", ""])], names=["lang", "source", "text"])
    found = Counter()
    for b in divergence.counted(iter([batch])):
        for r in b.to_pylist():
            found[r["source"], r["term"], "n"] += r["n"]
            found[r["source"], r["term"], "docs"] += r["docs"]
    assert found["s", "b", "n"] == 4 and found["s", "b", "docs"] == 2 and found["t", "a", "n"] == 3 and found["t", "a", "docs"] == 2
    big = np.array([9 * 10**15 - 7, 3, 10**12], np.int64)
    total = np.int64(9 * 10**15)
    assert divergence.share(big, total, 10**9).tolist() == [1 + 10**9 * int(n) // int(total) for n in big]


def plain_vector(text, dims, n):
    """The bundle of one text, n-gram by n-gram."""
    signs = re.sub(r" +", " ", " " + "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text) + " ")
    out = np.zeros(dims)
    for i in range(len(signs) - n + 1):
        bound = np.ones(dims)
        for j, c in enumerate(signs[i : i + n]):
            bound *= np.roll(language.letters(np.array([ord(c)], np.uint32), dims)[0], n - 1 - j)
        out += bound
    return out


def test_bundles(monkeypatch):
    texts = ["", "a", "Hello, World", "İstanbul ßÄ 日本語", "  x  y  ", "1 2 3", "ab" * 40]
    bundler = language.Bundler(256, 3)
    streams = [language.stream(t, True, np.empty(0, np.uint32)) for t in texts]
    want = np.array([plain_vector(t, 256, 3) for t in texts])
    want[[0, 5]] = 0  # no letter: fewer signs than an n-gram has
    assert (bundler.bundles(streams, np.arange(len(texts)), len(texts)) == want).all()
    monkeypatch.setattr(language, "NGRAMS", 5)
    assert (bundler.bundles(streams, np.arange(len(texts)), len(texts)) == want).all()
    monkeypatch.setattr(language, "CHUNK", 7)
    for t, v in zip(texts, want, strict=True):
        assert (language.vectors_of(t, None, bundler)[0][0] == v).all()
    many = np.array([ord(c) for c in "aäz日"], np.uint32)
    assert len(np.unique(language.letters(many, 512), axis=0)) == 4 and abs(language.letters(many, 4096).astype(float).mean()) < 0.05


def test_language(spark, sf, edge, none):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = queries.op13_language(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    tested = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in tested) >= 0.98 * len(tested)
    profiles = language.fit(docs)
    said = {r["doc_id"]: r for r in language.predict(edge, profiles).collect()}
    assert all(said[i]["lang_pred"] == "und" and said[i]["score"] == 0 for i in (0, 1, 2)) and said[5]["lang_pred"] == "en"
    assert language.predict(edge, profiles).count() == edge.count() and language.predict(none, profiles).count() == 0
    nothing = language.fit(none)
    assert {r["lang_pred"] for r in language.predict(edge, nothing).collect()} == {"und"}
    # held-out languages teach nothing
    changed = docs.withColumn("lang", F.expr("if(crc32(cast(doc_id as string)) % 3 = 1, 'zz', lang)"))
    again = language.fit(changed)
    assert again.langs == profiles.langs and np.allclose(again.prototypes, profiles.prototypes)
    with pytest.raises(ValueError):
        language.fit(docs, max_langs=2)


def test_language_by_hand(spark):
    """Cosines with prototypes made text by text."""
    rows = [(i, t, k) for i, (t, k) in enumerate([("the thing and that", "en"), ("und der die das", "de"), ("this is the one", "en"), ("ist das nicht schön", "de"), ("the and", None), ("das und", "")] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.predict(docs, language.fit(docs, dims=512)).collect()}
    learnt = defaultdict(lambda: np.zeros(512))
    for i, t, k in rows:
        if k is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            learnt[k] += plain_vector(t, 512, 3)
    unit = lambda v: v / np.linalg.norm(v)
    names = sorted(learnt)
    mean = np.mean([unit(learnt[k]) for k in names], axis=0)
    for i, t, _ in rows:
        v = unit(unit(plain_vector(t, 512, 3)) - mean)
        cosines = np.array([v @ unit(unit(learnt[k]) - mean) for k in names])
        weights = np.exp(12 * cosines)
        assert got[i]["lang_pred"] == names[int(cosines.argmax())] and got[i]["score"] == pytest.approx(weights.max() / weights.sum(), abs=1e-4)
