"""Token files, packing, personal data, quality, pages and nearest neighbours: round trips, plain versions, held-out figures."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from decisia.llm import ann, html, packing, pii, quality, queries, token_files
from decisia.llm.common import table, work_path
from decisia.llm.encoding import Encoder, encoder, tokenizer_path
from tests.llm.conftest import texts_of


#: The library's own, untouched by the code under test.
LIBRARY = Tokenizer.from_file(tokenizer_path())
SPECIAL = "<|endoftext|>"


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from([*" \n\n\tab,.'st　\xa0éx_1٣\0!\U0001f600", SPECIAL, SPECIAL[:5], SPECIAL[5:]]), max_size=40).map("".join))
def test_pieces_encode_like_the_library(text):
    (got,) = encoder(tokenizer_path()).encode([text])
    assert got.tolist() == ids_of(text)


def test_special_strings_as_text():
    text = f"a{SPECIAL} b"
    assert ids_of(text) == [64, 50256, 275]
    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    (got,) = encoder(tokenizer_path(), special=False).encode([text])
    assert got.tolist() == plain.encode(text, add_special_tokens=False).ids and 50256 not in got


def test_other_tokenizers_encode_whole():
    e = Encoder(tokenizer_path("word_bpe_49k.json"))
    assert e.pieces is None
    assert next(e.encode(["Some Words"])).tolist() == e.tokenizer.encode("Some Words", add_special_tokens=False).ids


def test_token_files(spark, edge, none):
    address = work_path(spark, "tokens")
    meta = token_files.write_tokens(edge, address, tokenizer_path(), end_id=2)
    got = sorted(token_files.read_tokens(spark, address, meta).collect(), key=lambda r: r["start"])
    rows = edge.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("by")).collect()
    want = [(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))]
    start = 0
    for row, (i, text) in zip(got, want, strict=True):
        ids = [*ids_of(text), 2]
        assert tuple(row) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    folder = token_files.Folder(address)
    for kind in ("bin", "off", "doc"):  # what a remote store reads in ranges is what a local one maps
        name, dtype = f"part-{meta['parts'][0]['part']:05d}.{kind}", meta["dtype"] if kind == "bin" else "<i8"
        whole, ranges = folder.array(name, dtype), token_files._Ranges(pa.OSFile(f"{folder.path}/{name}"), np.dtype(dtype))
        assert len(ranges) == len(whole) and (ranges[1:4] == whole[1:4]).all() and (ranges[0 : len(whole) + 9] == whole).all()
    part = meta["parts"][0]
    assert len(folder.array(f"part-{part['part']:05d}.bin", meta["dtype"])) == part["ids"]
    empty = work_path(spark, "tokens")
    assert token_files.read_tokens(spark, empty, token_files.write_tokens(none, empty, tokenizer_path(), end_id=2)).count() == 0


def check_pieces(rows, texts, length=2048):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    ids = {i: np.array([*ids_of(t), 1], "<u4") for i, t in texts}
    copies = Counter(i for i, _ in texts)
    for i, pieces in docs.items():
        if copies[i] > 1:
            continue
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[i])
            at += p["length"]
            assert zlib.crc32(ids[i][p["start"] : at].tobytes()) == p["ids_crc32"]
        assert at == len(ids[i])
    padding = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


def test_packing(spark, edge, none, sf):
    assert packing.pack(none, tokenizer_path(), 1).count() == 0
    for docs in (edge, table(spark, sf, "documents")):
        rows, texts = packing.pack(docs, tokenizer_path(), 1).collect(), texts_of(docs)
        assert sum(r["length"] for r in rows) == sum(len(ids_of(t)) + 1 for _, t in texts)
        assert check_pieces(rows, texts) == 0


def test_sum_of_squares_rule():
    """Each choice is the one after which the sum of squared counts of open levels is least."""
    r, closed = random.Random(3), []
    packer = packing.Packer(32, closed.append)
    for i in range(400):
        size = r.randint(1, 31)
        before = packer.count.copy()
        options = {}
        for level in [0, *np.flatnonzero(before).tolist()]:
            if level + size <= 32:
                after = before.copy()
                after[level] -= level > 0
                after[level + size] += level + size < 32
                options[level] = int((after**2).sum())
        packer.add(i, np.zeros(size, "<u4"))
        assert int((packer.count**2).sum()) == min(options.values())


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab@.+-_ 0123456789()%é"), max_size=60))
def test_base_spans(text):
    found = pii.spans_of(text)
    assert pii.joined(found, pii.KINDS[:4]) == plain_pii(text)


def test_pii(spark, edge, none, sf):
    assert pii.find_pii(none).count() == 0
    for docs in (edge, table(spark, sf, "documents")):
        texts = Counter((i, hashlib.sha256(plain_pii(t).encode()).hexdigest()) for i, t in texts_of(docs))
        assert Counter((r["doc_id"], r["base_sha256"]) for r in pii.find_pii(docs).collect()) == texts


def test_pii_cues():
    text = 'IBAN: DE89 3704 0044 0532 0130 00, token = "04dbebab91ab85687d33ee" account no. 12345678 see https://a.example/x?y=1. tokens are words'
    found = pii.spans_of(text)
    assert [text[a:b] for a, b in found["account"]] == ["DE89 3704 0044 0532 0130 00", "12345678"]
    assert [text[a:b] for a, b in found["secret"]] == ["04dbebab91ab85687d33ee"]
    assert [text[a:b] for a, b in found["url"]] == ["https://a.example/x?y=1"]


def test_quality_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op2_quality(spark, sf_dir).collect()
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    assert len(rows) == table(spark, sf_dir, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) / len(held) >= 0.95


def plain_terms(text):
    """Logged counts of byte trigrams and of runs of four character classes by their hashes, and the facts of the words."""
    data, out = text.encode(), np.zeros(quality.TERMS)
    for k in range(len(data) - 2):
        out[(sum(c * m for c, m in zip(data[k : k + 3], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=True)) % 2**32) >> 21] += 1
    kinds = [int(quality.CLASSES[c]) for c in data]
    for k in range(len(data) - 3):
        out[quality.TRIGRAMS + ((sum(c * m for c, m in zip(kinds[k : k + 4], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F), strict=True)) % 2**32) >> 22)] += 1
    words = data.split()
    out = np.log1p(out)
    capitals, signs = (sum(bool(x[c]) for c in data) for x in (quality.CAPITAL, quality.SIGN))
    out[quality.TRIGRAMS + quality.SHAPES :] = quality.facts(len(data), capitals, signs, len(words), len(set(words)), sum(a == b for a, b in zip(words, words[1:], strict=False)))
    return out


def plain_vote(model, x):
    """The vote of the nearest labelled vectors on one row of terms, in double precision, one after another."""
    x = x * model.idf
    for a, e in ((0, quality.TRIGRAMS), (quality.TRIGRAMS, quality.TRIGRAMS + quality.SHAPES), (quality.TRIGRAMS + quality.SHAPES, quality.TERMS)):
        x[a:e] /= max(1e-9, np.sqrt((x[a:e] ** 2).sum()))
    v = x @ model.projection.astype(np.float64)
    v /= max(1e-9, np.sqrt((v**2).sum()))
    near = sorted(((float(u @ v), -k) for k, u in enumerate(model.vectors.astype(np.float64))), reverse=True)[: model.neighbours]
    weight = [max(c, 1e-6) ** model.power for c, _ in near]
    return sum(w * float(model.labels[-k]) for w, (_, k) in zip(weight, near, strict=True)) / sum(weight)


def test_quality_against_a_plain_version(spark, edge, sf):
    """Every document of a table and every odd one: terms counted sign by sign, then cosines and votes one by one."""
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, labels)
    for frame in (docs, edge.where("doc_id is null or doc_id <> 12")):
        got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["score"]) for r in quality.score(frame, model).collect())
        want = sorted((i is not None, i or 0, plain_vote(model, plain_terms(t))) for i, t in texts_of(frame))
        for a, b in zip(got, want, strict=True):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-3


@pytest.mark.parametrize("block", [50, 1000])
def test_quality_terms_in_blocks(block, monkeypatch):
    text = "Some words, SOME words again again " * 40 + "x" * 300 + " end\n\n"
    whole = quality.counted([text.encode()])[0]
    monkeypatch.setattr(quality, "CHUNK_BYTES", block)
    assert (quality.counted_in_blocks(text.encode()) == whole).all()
    assert (quality.terms([b"", text.encode()])[1] == quality.terms([text.encode()])[0]).all()


def test_quality_labels_of_absent_documents(spark):
    """Labels of documents that aren't there take no place in the sample."""
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"document number {i}") for i in ids[-8:]], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int"), max_labelled=8)
    assert len(model.labels) == 8


def test_quality_edges(spark, edge, none):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (5, 1, 0), (8, None, 0), (None, 1, 0), (999, 0, 0), (13, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(edge, labels)
    assert quality.score(edge, model).count() == edge.count()
    assert quality.score(none, model).count() == 0
    assert quality.keep_good(edge, model).columns == edge.columns
    assert quality.fit(edge, labels.limit(0)) is None
    assert {r["score"] for r in quality.score(edge, None).collect()} == {0.5}


def test_quality_repeated_ids(spark):
    """A labelled id of many rows has one place in the sample, so the others keep theirs, in whatever order rows come."""
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:4]
    rows = [(ids[0], f"copy {k % 3} of one document") for k in range(60)] + [(i, f"document {i} alone") for i in ids[1:]]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    models = [quality.fit(spark.createDataFrame(some, "doc_id long, text string"), labels, max_labelled=4) for some in (rows, rows[::-1])]
    assert [len(m.labels) for m in models] == [4, 4]
    assert (models[0].vectors == models[1].vectors).all()


PAGES = [
    (1, "http://h.example/a/1", "<html><body><div>Shop of h</div><nav><a>Home</a></nav><div><p>First&nbsp;story,\n  told &amp; retold</p></div><p>Call us</p></body></html>"),
    (2, "http://h.example/a/2", "<html><body><div>Shop of h</div><div><p>Second story</p></div><p>Call us</p></body></html>"),
    (3, "http://h.example/b", "<body><article><h1>T</h1><p>Call us<script>x='</p>'</script><div class='share-bar'>tweet</div><p>More <b>bold</b>er</article><div id=comments><p>nice</p></div><footer>c</footer>"),
    (4, "http://alone.example/x", "<p>Only text<br>of its host</p><form><p>sign up</p></form>"),
    (5, None, None),
    (6, "http://h.example/b", ""),
]


def test_pages(spark):
    pages = spark.createDataFrame([(*p, "x", 1) for p in [*PAGES, PAGES[3]]], "page_id long, url string, html string, text string, host int")
    got = sorted((r["page_id"], r["text"]) for r in html.extract(pages).collect())
    assert got == [(1, "First story, told & retold"), (2, "Second story"), (3, "T\n\nCall us\n\nMore bolder"), (4, "Only text of its host"), (4, "Only text of its host"), (5, ""), (6, "")]
    assert html.extract(pages.limit(0)).count() == 0


def test_pages_open_lines_beside_an_article(spark):
    """An article element may be a teaser only: lines in the open stay there too unless a neighbour shares them."""
    rows = [(i, f"http://h.example/{i}", f"<body><div>Shop of h</div><article><p>Lead {i}</p></article><p>Body {i}</p><nav>n {i}</nav><p>Call us</p></body>") for i in range(3)]
    rows.append((3, "http://alone.example/", "<body><main><p>Lead 3</p></main><p>Body 3</p></body>"))
    got = sorted((r["page_id"], r["text"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(i, f"Lead {i}\n\nBody {i}") for i in range(4)]


def test_pages_in_runs_of_copies(spark):
    """All copies of a run lose what the nearest page that differs shares, within and across the ranges of tasks."""
    copy = "<body><div>Shop of h</div><p>Story</p><div>Call us</div></body>"
    rows = [(0, "http://h.example/0", "<body><div>Shop of h</div><p>First</p></body>"), (99, "http://h.example/99", "<body><p>Last</p><div>Call us</div></body>")]
    rows += [(i, f"http://h.example/{i}", copy) for i in range(10, 40)] + [(None, "http://h.example/20", copy), (200, "http://only.example/1", copy), (201, "http://only.example/2", copy), (202, "http://only.example/3", copy)]
    for n in ("1", "3", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {(r["page_id"], r["url"]): r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert len(got) == len(rows)
        for page, url, _ in rows:
            assert got[page, url] == ("First" if page == 0 else "Last" if page == 99 else "Shop of h\n\nStory\n\nCall us" if page and page >= 200 else "Story"), (n, page)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pages_whatever_the_ranges(spark):
    """Pairs are those of the whole order, so the number of tasks changes nothing."""
    rows = [(i, f"http://h{i % 3}.example/{i // 7}/{i}", f"<body><div>top {i % 2}</div><p>text {i}</p><div>bottom {i // 20}</div></body>") for i in range(90)]
    results = []
    for n in ("1", "7", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(tuple(r) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]


class PlainPage(HTMLParser):
    """Lines (words, slot, box, in the article, named, heading) of pages as the test tables have them, by the standard parser."""

    def __init__(self, html):
        super().__init__()
        self.stack, self.lines, self.held, self.raw = [], [], [], 0
        self.feed(html)
        self.flush()

    def flush(self):
        words = " ".join("".join(self.held).split())
        self.held = []
        if words:
            path = [t for t in self.stack if t.split(".")[0] != "b"]
            tags = [t.split(".")[0] for t in path]
            box = tuple(path[: max([k + 1 for k, t in enumerate(tags) if t not in ("p", "li", "h1")], default=0)])
            self.lines.append((words, tuple(path), box, "article" in tags, bool({"nav", "footer", "div.ad", "aside", "header"} & {*path, *tags}), tags[-1:] == ["h1"]))

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.raw += 1
        elif tag == "br":
            self.held.append(" ")
        elif tag not in ("meta", "a"):
            if tag != "b":
                self.flush()
            if tag == "p" and "p" in self.stack:
                del self.stack[len(self.stack) - 1 - self.stack[::-1].index("p") :]
            self.stack.append(f"{tag}.{dict(attrs)['class']}" if dict(attrs).get("class") else tag)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.raw -= 1
        elif tag not in ("a", "b"):
            self.flush()
            tags = [t.split(".")[0] for t in self.stack]
            if tag in tags:
                del self.stack[len(tags) - 1 - tags[::-1].index(tag) :]

    def handle_data(self, data):
        if not self.raw:
            self.held.append(data)


def plain_alignment(a, b):
    """Places in a of a longest common subsequence, late rows left out where they add nothing."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    found, i, j = set(), len(a), len(b)
    while i:
        if best[i][j] > best[i - 1][j]:
            found.add(i - 1)
            now = best[i][j]
            while best[i][j] == now:
                j -= 1
        i -= 1
    return found


def plain_pages(rows):
    """The texts of pages (page_id, url, html), each with the nearest pages of its host that differ."""
    order = []
    for page, url, html_text in rows:
        rest = (url or "").split("://", 1)[-1]
        host = re.match(r"[^/?#]*", rest)[0].lower().split("@")[-1].removeprefix("www.")
        order.append((host, re.match(r"[^/?#]*([^?#]*)", rest)[1], page, PlainPage(html_text or "").lines))
    order.sort(key=lambda r: r[:3])
    out = {}
    for k, (host, _, page, own) in enumerate(order):
        words, slots = set(), set()
        places = [j for j in range(len(own)) if not j or own[j][1] != own[j - 1][1]] + [len(own)]
        for step in (-1, 1):
            j = k + step
            while 0 <= j < len(order) and order[j][0] == host and order[j][3] == own:
                j += step
            if 0 <= j < len(order) and order[j][0] == host:
                other = order[j][3]
                words |= plain_alignment([x[0] for x in own], [x[0] for x in other])
                runs = [x[1] for n, x in enumerate(other) if not n or x[1] != other[n - 1][1]]
                for place in plain_alignment([own[j][1] for j in places[:-1]], runs):
                    slots |= set(range(places[place], places[place + 1]))
        article, box = sum(len(x[0]) for x in own if x[3]), Counter()
        for n, x in enumerate(own):
            box[x[2]] += 0 if x[3] or n in words else len(x[0])
        kept, shared = [], 0
        for n, x in enumerate(own):
            gone = not x[3] and (n in words or n in slots and 5 * box[x[2]] < article and not x[5])
            shared += gone
            if x[3] or not gone and not x[4]:
                kept.append(x[0])
        out[page] = ("\n\n".join(kept), shared)
    return out


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_pages_against_a_plain_version(spark, folder):
    """Whole table: texts, and the count of lines that the neighbours decided, which are most of those that go."""
    sf_dir = f"/root/testdata/{folder}"
    rows = [tuple(r) for r in table(spark, sf_dir, "pages").select("page_id", "url", "html").collect()]
    got = queries.op6_page_text(spark, sf_dir).collect()
    want = plain_pages(rows)
    assert {r["page_id"]: (r["text"], r["n_shared"]) for r in got} == want and len(got) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert sum(r["n_shared"] for r in got) > (sum(r["n_named"] for r in got) if folder == "sf0.001" else 2 * sum(r["n_named"] for r in got))


def test_pages_without_names(spark):
    """With the lists of names switched off, differencing alone finds menus, adverts and footers of most pages."""
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    with_names = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    without = {r["page_id"]: (r["text"], r["n_named"]) for r in html.extract(pages, names=False).collect()}
    assert all(n == 0 for _, n in without.values())
    assert sum(with_names[i] == t for i, (t, _) in without.items()) >= 0.85 * len(without)


def test_pages_of_odd_make():
    texts = lambda page: html.result(*html.page_lines(page), [])[0]
    assert texts("<article><header class='header'><h1>T</h1></header><p>x<footer>by me</footer></article>") == "T\n\nx"
    assert texts("<form id=f><div><article><p>x</article></div><p>field</p></form>") == "x"
    assert texts("<div class='page menu-open'><main><p>x</main><p>y</div>") == "x"
    assert texts("<p title='a>b'>x <i data-x=it's>y</i> &lt;z&gt; 1 < 2 <![CDATA[c]]></p><!-- never closed <p>w") == "x y <z> 1 < 2 c"
    assert texts("<p>x<a href=\"never closed>y</a><p>z") == "xy\n\nz"
    assert texts("<p>x<script>never closed <p>z") == "x"


@pytest.mark.parametrize("page", ["<div>" * 400_000, "<b></i>" * 300_000, '<a href="x' * 200_000, "<p>x" * 100_000, "<div class=a><p>t" * 100_000, "<" * 2_000_000])
def test_pages_long_and_deep(page):
    """Two million signs of nested or broken tags are worked off in one pass."""
    start = time.process_time()
    lines, _ = html.page_lines(page)
    html.decided(lines, [lines[1:]])
    assert time.process_time() - start < 30


def test_alignment_in_parts(monkeypatch):
    r = random.Random(1)
    a, b = ([r.randrange(9) for _ in range(n)] for n in (300, 200))
    whole = html.shared(a, b)
    monkeypatch.setattr(html, "TABLE_BITS", 500)
    parts, rest = sorted(html.shared(a, b)), iter(b)
    assert len(parts) == len(whole) and all(a[i] in rest for i in parts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_shared_lines(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    found, rest = sorted(html.shared(a, b)), iter(b)
    assert len(found) == best[-1][-1] and all(a[i] in rest for i in found)


def test_nearest_in_blocks(spark):
    """Groups, shards and blocks of any size give the same neighbours of clustered data."""
    r = np.random.Generator(np.random.PCG64(5))
    centre = r.normal(size=(12, 8)) * 10
    vectors = spark.createDataFrame([(i, [float(v) for v in centre[i % 12] + r.normal(size=8)]) for i in range(2400)], "vec_id long, embedding array<float>")
    ways = [sorted(tuple(x) for x in ann.search(vectors, vectors.where("vec_id % 10 = 0"), **some).collect()) for some in ({}, {"shard_rows": 60, "block_queries": 7})]
    assert ways[0] == ways[1]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_nearest_recall(spark, folder):
    sf_dir = f"/root/testdata/{folder}"
    rows = table(spark, sf_dir, "embeddings").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = defaultdict(list)
    for r in sorted(queries.op8_nearest(spark, sf_dir).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = wanted = 0
    for i in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        far[i] = np.inf
        best = ids[np.lexsort((ids, far))[:10]]
        found = got[ids[i]]
        assert len(found) == len(best)
        assert all(abs(s - far[ids == v][0]) < 1e-9 for v, s in found) and found == sorted(found, key=lambda f: (f[1], f[0]))
        hits, wanted = hits + len({v for v, _ in found} & set(best.tolist())), wanted + len(best)
    assert hits / wanted >= 0.9


def test_nearest_edges(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(12)] + [(100, None), (200, [0.0, 0.0]), (300, [1.0, float("nan")]), (400, [1.0, None]), (500, [1.0]), (None, [1.0, 1.0]), (0, [0.0, 1.0])]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, list int, code string")
    got = [tuple(r) for r in ann.search(vectors, vectors.where("vec_id % 100 = 0"), k=5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 0.0), (0, 2, 6, 0.0), (0, 3, 9, 0.0), (0, 4, 1, 1.0), (0, 5, 4, 1.0)]
    assert ann.search(vectors.limit(0), vectors.limit(0)).count() == 0
    # repeated ids with other vectors: the nearest counts, one query asks; doubles are ranked as doubles; another length takes no part
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1e-9]), (2, [1.0, 2e-9]), (3, [5.0, 5.0]), (3, [1.0, 0.5]), (100, [1.0, 0.0, 0.0]), (4, [1e300, 1.0])]
    doubles = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.search(doubles, doubles.where("vec_id % 100 = 0")).orderBy("rank").collect()]
    assert got[:3] == [(0, 1, 1, 1e-9), (0, 2, 2, 2e-9), (0, 3, 3, 0.5)] and len(got) == 4 and got[3][:3] == (0, 4, 4) and got[3][3] == pytest.approx(doubles.where("vec_id = 4").first()[1][0])
    two = vectors.where("vec_id < 2")
    assert ann.search(two, two.where("vec_id = 0")).count() == 1


def test_components_beyond_floats(spark):
    """Doubles that no float holds, or whose squares none holds, take part; what is beyond doubles doesn't."""
    r = np.random.Generator(np.random.PCG64(3))
    for size in (1e200, 3e38, 1e30):
        rows = [(i, [float(x) * size for x in v]) for i, v in enumerate(r.standard_normal((120, 8)))] + [(500, [float("inf")] * 8)]
        vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = [tuple(x) for x in ann.search(vectors, vectors.where("vec_id % 100 = 0"), k=5).orderBy("query_id", "rank").select("query_id", "rank", "vec_id").collect()]
        x = np.array([v for _, v in rows[:120]]) / size
        want = [(q, k + 1, int(i)) for q in (0, 100) for k, i in enumerate([i for i in np.argsort(((x - x[q]) ** 2).sum(1), kind="stable") if i != q][:5])]
        assert len(set(got) & set(want)) >= 9


def test_lists_grow(spark, monkeypatch):
    """The sample holds eight vectors a list up to its bound."""
    made = []
    monkeypatch.setattr(ann, "LEAST_SAMPLE", 16)
    plain = ann.kmeans
    monkeypatch.setattr(ann, "kmeans", lambda x, k, rounds=8: made.append((len(x), k)) or plain(x, k, rounds))
    r = np.random.Generator(np.random.PCG64(5))
    vectors = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(r.standard_normal((900, 4)))], "vec_id long, embedding array<float>")
    for most, want in ((10_000, (240, 30)), (80, (80, 10))):
        ann.search(vectors, vectors.where("vec_id = 0"), max_sample=most)
        assert made[0] == want
        made.clear()


@pytest.mark.parametrize("kind", ["many dimensions", "far from zero", "many scales"])
def test_nearest_recall_on_other_rows(spark, kind):
    """Bounds are measured on the rows there are: vectors of many dimensions without clusters, offsets that floats can't take squares of, vectors of a thousand lengths."""
    r = np.random.Generator(np.random.PCG64(11))
    x = {"many dimensions": lambda: r.standard_normal((4000, 512)), "far from zero": lambda: 1e7 + r.standard_normal((4000, 32)), "many scales": lambda: r.standard_normal((4000, 64)) * np.exp(3 * r.standard_normal((4000, 1)))}[kind]()
    vectors = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    got = defaultdict(set)
    for row in ann.search(vectors, vectors.where("vec_id % 100 = 0")).collect():
        got[row["query_id"]].add(row["vec_id"])
    hits = 0
    for i in range(0, len(x), 100):
        far = ((x - x[i]) ** 2).sum(1)
        far[i] = np.inf
        hits += len(got[i] & set(np.argsort(far, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 400
