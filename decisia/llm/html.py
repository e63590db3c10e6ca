"""Main text of web pages by nearest-URL page differencing.

A page is cut into lines, its text blocks. Pages of a host are put in the order of their URL paths, and each is paired with
its neighbours, those of the nearest paths whose lines are not all the same as its own: pages next to each other with all the
same lines are copies, which tell nothing of each other, so a run of them meets the pages before and after it. The lines of
both are aligned by longest common subsequences, once by their words and once by their slots (where an element stands and what
it is called), runs of one slot being one place. Outside the article, a line goes

* if a neighbour shares its words (it is the host's template),
* if a neighbour shares its slot, with other words, and its box is light: the page's article holds more than LIGHT times the
  box's own text (menus, notices and footers whose words change from page to page),
* where differencing doesn't decide (no neighbour has the slot, or the article is too short to weigh against), if an element
  around it is named as beside the article: navigation, header, footer, sidebar, advert, form, notice, comments.

Every other line stays. Lines inside an article or main element stay even if a neighbour shares them, since articles quote each
other and near copies of one article stand side by side; so do headings whose words no neighbour shares. n_shared counts the lines that
the neighbours decided, n_named those that only names did; with names=False the latter are kept.

Scale: each page is parsed once, where it is read; its line keys and texts, compressed, go through one shuffle by ranges of host
and path, so that a host may fill any number of tasks. Ranges are cut by a sample of URLs (SAMPLED a range; it moves only their edges). Only
the runs at both ends of a range wait for a second step, four rows of line keys a range, in windows of their hosts. A run of
copies is one text and the ids and URLs of its pages. The parser and the decisions are linear in a page's length; alignments
keep bits of the lines that both pages have, and are divided when those are many.

Cases: null and empty pages have the empty text; null URLs form one host of their own; ties in URL go by page id, then by a hash of
the html; repeated rows are copies; very long pages and deep nesting are worked off in one pass; an empty table gives no rows;
extra columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decisia.llm.common import partitions, text_of, written

# Elements by what they do to a page's text.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RAW = frozenset(("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "title"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Blocks that hold text and no other blocks worth a box of their own.
LEAVES = HEADINGS | {"blockquote", "caption", "center", "dd", "dt", "figcaption", "hr", "legend", "li", "option", "p", "pre", "summary", "td", "th"}
BOXES = frozenset(("address", "article", "aside", "body", "details", "dialog", "dir", "div", "dl", "fieldset", "figure", "footer", "form", "head", "header", "hgroup", "html", "main", "menu", "nav", "ol", "section", "select", "table", "tbody", "tfoot", "thead", "tr", "ul"))
BLOCK = LEAVES | BOXES
CLOSES_P = BLOCK - {"html", "body", "head", "caption", "legend", "option", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
ASIDE = frozenset(("nav", "header", "footer", "aside", "button", "select", "dialog", "menu", "head"))
ASIDE_NAMES = frozenset((
    "ad", "ads", "adv", "advert", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "notice", "alert",
    "popup", "modal", "overlay", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "masthead", "comment", "comments",
    "disqus", "reply", "replies", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "pagination",
    "pager", "toolbar", "widget", "copyright",
))
ASIDE_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"))

NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
PLAIN = re.compile(r"[^>\"']*")
NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW_END = {tag: re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I) for tag in RAW}
BLANKS = re.compile(r"\s+")
NAME_PARTS = re.compile(r"[A-Za-z]+")

#: Zones of a line. BESIDE by its names; FORM is beside as well, but an article inside a form is an article.
OPEN, ARTICLE, BESIDE, FORM = range(4)
LIGHT = 5
LINE = np.dtype([("words", "<i8"), ("slot", "<i8"), ("box", "<i8"), ("size", "<i4"), ("zone", "i1"), ("heading", "?")])
#: Pages looked at for each range when ranges are cut; the list of edges, one a range, goes to all tasks.
SAMPLED = 60
NO_ID = -(2**63)
#: Bits that one alignment keeps in memory.
TABLE_BITS = 1 << 29


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@functools.lru_cache(65536)
def inside(slot: int, name: str) -> int:
    """The slot of an element of that name in a slot."""
    return digest(f"{slot}/{name}")


def is_beside(tag: str, attributes: str, zone: int) -> bool:
    own_header = tag == "header" and zone == ARTICLE  # the header of an article holds its title
    if tag in ASIDE and not own_header:
        return True
    for name, a, b, c in NAMED.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ASIDE_ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and not ASIDE_NAMES.isdisjoint(p for p in NAME_PARTS.findall(value) if not (own_header and p == "header")):
            return True
    return False


class Parser:
    """Lines of a page in one pass: open elements are found by their names' last places, never by a walk over all of them."""

    def __init__(self, html: str, names: bool) -> None:
        self.html, self.names = html, names
        self.lines: list[tuple] = []
        self.held: list[str] = []
        self.stack: list[tuple[str, int, int, int]] = []  # tag, zone inside, slot, box
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.unclosed: set[str] = set()

    def flush(self) -> None:
        if self.held:
            text = BLANKS.sub(" ", unescape("".join(self.held))).strip()
            self.held.clear()
            if text:
                _, zone, slot, box = self.stack[-1] if self.stack else ("", OPEN, 0, 0)
                heading = bool(self.blocks) and self.stack[self.blocks[-1]][0] in HEADINGS
                self.lines.append((digest(text), slot, box, len(text), zone, heading, text))

    def close(self, upto: int) -> None:
        for at in range(len(self.stack) - 1, upto - 1, -1):
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if self.blocks and self.blocks[-1] == at:
                self.blocks.pop()

    def open(self, tag: str, attributes: str) -> None:
        _, zone, slot, box = self.stack[-1] if self.stack else ("", OPEN, 0, 0)
        if tag == "main" or tag == "article" and zone != BESIDE:
            inner = ARTICLE
        elif zone == BESIDE or self.names and is_beside(tag, attributes, zone):
            inner = BESIDE
        else:
            inner = FORM if tag == "form" and self.names else zone
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
            called = CLASS.search(attributes) if attributes else None
            called = NAME_PARTS.findall((called[1] or called[2] or called[3] or "").lower()) if called else ()
            slot = inside(slot, " ".join((tag, *called)))
            if tag in BOXES:
                box = slot
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, inner, slot, box))

    def attributes_end(self, at: int) -> int:
        """Where the sign that ends a tag stands (or the page ends); quotes count only around values."""
        html = self.html
        while True:
            end = PLAIN.match(html, at).end()
            if end >= len(html) or html[end] == ">":
                return end
            quote, at = html[end], end + 1
            if quote not in self.unclosed and html[max(0, end - 16) : end].rstrip().endswith("="):
                closing = html.find(quote, at)
                if closing < 0:
                    self.unclosed.add(quote)
                else:
                    at = closing + 1

    def parse(self) -> list[tuple]:
        html, at, size = self.html, 0, len(self.html)
        while at < size:
            sign = html.find("<", at)
            if sign < 0:
                break
            if sign > at:
                self.held.append(html[at:sign])
            if html.startswith("<!--", sign):
                end = html.find("-->", sign + 4)
                at = size if end < 0 else end + 3
            elif html.startswith("<![CDATA[", sign):
                end = html.find("]]>", sign)
                self.held.append(html[sign + 9 : size if end < 0 else end].replace("&", "&amp;"))
                at = size if end < 0 else end + 3
            elif html.startswith(("<!", "<?"), sign):
                end = html.find(">", sign)
                at = size if end < 0 else end + 1
            elif m := NAME.match(html, sign):
                end = self.attributes_end(m.end())
                at = self.tag(m[1].lower(), html[sign + 1] == "/", html[m.end() : end], min(size, end + 1))
            else:
                self.held.append("<")
                at = sign + 1
        if at < size:
            self.held.append(html[at:])
        self.flush()
        return self.lines

    def tag(self, tag: str, ends: bool, attributes: str, at: int) -> int:
        """Works a tag in; returns where the page goes on."""
        if ends:
            if tag in BLOCK:
                self.flush()
            places = self.places.get(tag)
            if places and (tag in BLOCK or not self.blocks or self.blocks[-1] < places[-1]):  # an inline end can't close a block
                if self.blocks and self.blocks[-1] >= places[-1]:
                    self.flush()
                self.close(places[-1])
            return at
        if tag in RAW:
            if attributes.endswith("/") and tag in ("svg", "math"):
                return at
            end = RAW_END[tag].search(self.html, at)
            return end.end() if end else len(self.html)
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES_P and self.places.get("p"):
                self.close(self.places["p"][-1])
        if tag in VOID:
            if tag in ("br", "wbr", "img", "input"):
                self.held.append(" ")
        elif not (attributes.endswith("/") and tag not in BLOCK):
            self.open(tag, attributes)
        return at


def page_lines(html: str, names: bool = True) -> tuple[np.ndarray, list[str]]:
    """The lines' keys and their texts, references decoded and white space made single; without the texts of lines named as beside, which go in any case."""
    found = Parser(html, names).parse()
    return np.array([x[:6] for x in found], LINE), ["" if x[4] >= BESIDE else x[6] for x in found]


def shared(a: list[int], b: list[int]) -> set[int]:
    """Places in a of a longest common subsequence with b. What only one of them has is left out first."""
    other, own = set(b), set(a)
    ia, ib = [i for i, x in enumerate(a) if x in other], [x for x in b if x in own]
    return {ia[n] for n in aligned([a[i] for i in ia], ib)}


def aligned(a: list[int], b: list[int]) -> list[int]:
    """Rows of the table are bit sets; a table beyond TABLE_BITS is cut at the middle of a where the lengths of both halves add up."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > TABLE_BITS:
        half = len(a) // 2
        upto = lengths(table_rows(a[:half], b, last=True)[-1], len(b))
        rest = lengths(table_rows(a[half:][::-1], b[::-1], last=True)[-1], len(b))[::-1]
        cut = int(np.argmax(upto + rest))
        return aligned(a[:half], b[:cut]) + [half + n for n in aligned(a[half:], b[cut:])]
    rows, found, j = table_rows(a, b), [], len(b)
    for n in range(len(a) - 1, -1, -1):
        # the length at (n, j) is the number of zero bits below j in row n
        now = j - (rows[n] & ((1 << j) - 1)).bit_count()
        before = j - (rows[n - 1] & ((1 << j) - 1)).bit_count() if n else 0
        if now > before:
            found.append(n)
            while j and (j - (rows[n] & ((1 << j) - 1)).bit_count()) == now:
                j -= 1
    return found[::-1]


def table_rows(a: list[int], b: list[int], last: bool = False) -> list[int]:
    """A bit for each place of b in each row, 0 where the length grows. Places of a line that is often in b are kept as bits."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    often = {x: sum(1 << j for j in some) for x, some in places.items() if len(some) > 64}
    full = (1 << len(b)) - 1
    rows, v = [], full
    for x in a:
        u = v & (often[x] if x in often else sum(1 << j for j in places.get(x, ())))
        v = ((v + u) | (v - u)) & full
        if last:
            rows = [v]
        else:
            rows.append(v)
    return rows


def lengths(row: int, size: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-size // 8), "little"), np.uint8), bitorder="little")[:size]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def shared_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which places of a are in a run of one slot that is aligned with a run of b."""
    if not len(a) or not len(b):
        return np.zeros(len(a), bool)
    heads = [np.flatnonzero(np.append(True, x[1:] != x[:-1])) for x in (a, b)]
    hit = np.zeros(len(heads[0]), bool)
    hit[sorted(shared(a[heads[0]].tolist(), b[heads[1]].tolist()))] = True
    return np.repeat(hit, np.diff(np.append(heads[0], len(a))))


def decided(own: np.ndarray, neighbours: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which lines the neighbours decide to be template, and which only names do."""
    words, slots = np.zeros(len(own), bool), np.zeros(len(own), bool)
    for other in neighbours:
        words[list(shared(own["words"].tolist(), other["words"].tolist()))] = True
        slots |= shared_slots(own["slot"], other["slot"])
    article, named = own["zone"] == ARTICLE, own["zone"] >= BESIDE
    weight, box = int(own["size"][article].sum(dtype=np.int64)), Counter()
    for b, n in zip(own["box"][~article & ~words].tolist(), own["size"][~article & ~words].tolist(), strict=True):
        box[b] += n
    light = np.array([LIGHT * box[b] < weight for b in own["box"].tolist()], bool)
    gone = ~article & (words | slots & light & ~own["heading"])
    return gone, ~article & named & ~gone


def result(own: np.ndarray, texts: list[str], neighbours: list[np.ndarray]) -> tuple[str, int, int]:
    gone, named = decided(own, neighbours)
    return "\n\n".join(t for t, drop in zip(texts, (gone | named).tolist(), strict=True) if not drop), int(gone.sum()), int(named.sum())


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.lower(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0)), "@", -1), r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def rest_of(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")


PAIRED = "page_id long, url string, text string, n_shared long, n_named long, part int, run int, first boolean, last boolean, host string, keys binary, texts array<string>"
PAIRED_TYPES = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.binary(), pa.list_(pa.string()))


class Pairing:
    """The runs of a task's range in turn: each is decided when the one after it is known; those at the ends wait for the second step."""

    def __init__(self, part: int) -> None:
        self.part, self.out, self.size = part, [], 0

    def put(self, *row) -> Iterator[pa.RecordBatch]:
        self.out.append(row)
        self.size += 200 + len(row[2] or "") + sum(map(len, row[11] or ()))
        if self.size > 4 << 20:
            yield self.made()

    def made(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.out, strict=True), PAIRED_TYPES, strict=True)], names=[x.split()[0] for x in PAIRED.split(", ")])
        self.out, self.size = [], 0
        return batch

    def close(self, before: dict | None, run: dict, after: dict | None) -> Iterator[pa.RecordBatch]:
        nothing = (None,) * 5
        if before and after:
            text, gone, named = result(unpacked(run["keys"]), run["texts"], [unpacked(n["keys"]) for n in (before, after) if n["host"] == run["host"]])
            for page, url in run["pages"]:
                yield from self.put(page, url, text, gone, named, None, None, *nothing)
        else:
            for page, url in run["pages"]:
                yield from self.put(page, url, None, None, None, self.part, run["run"], *nothing)
        # the second run from either end is kept for the second step too, as a neighbour of the first
        if run["run"] < 2:
            yield from self.end(run, before is None, after is None)
        run["pages"] = ()
        if before:
            before["texts"] = ()

    def end(self, run: dict, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        yield from self.put(None, None, None, None, None, self.part, run["run"], first, last, run["host"], run["keys"], run["texts"] if first or last else [])


def split(text: str, lines: np.ndarray) -> list[str]:
    ends = np.cumsum(np.where(lines["zone"] >= BESIDE, 0, lines["size"]), dtype=np.int64).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def unpacked(keys: bytes) -> np.ndarray:
    return np.frombuffer(keys, LINE)


def edges(rows: DataFrame, ranges: int) -> list[tuple]:
    """Where ranges of (host, path, page_id, mark) begin: quantiles of a sample by digests."""
    total = rows.count()
    every = max(1, total // (SAMPLED * ranges))
    key = ["host", "path", "page_id", "mark"]
    found = sorted(tuple(r) for r in rows.where(F.pmod(F.xxhash64("url", "page_id", "mark"), F.lit(every)) == 0).select(*key).toLocalIterator())
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def extract(pages: DataFrame, names: bool = True, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_shared, n_named of every page."""
    spark, url = pages.sparkSession, F.col("url")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    rows = rows.select(F.coalesce("page_id", F.lit(NO_ID)).alias("page_id"), "url", host_of(url).alias("host"), path_of(url).alias("path"), F.xxhash64("html").alias("mark"), "html")
    sent = spark.sparkContext.broadcast(edges(rows, partitions(spark)))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            part, keys, texts = [], [], []
            ids, hosts, paths, marks = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            for key, html in zip(zip(hosts, paths, ids, marks, strict=True), batch.column(5), strict=True):
                lines, found = page_lines(html.as_py(), names)
                part.append(bisect_right(sent.value, key))
                keys.append(pack.compress(lines.tobytes()))
                texts.append(pack.compress("".join(found).encode()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(batch.column(i) for i in (0, 1, 2, 3, 4)), pa.array(keys, pa.binary()), pa.array(texts, pa.binary())], names=["part", "page_id", "url", "host", "path", "mark", "keys", "texts"])

    parsed = rows.mapInArrow(parse, "part int, page_id long, url string, host string, path string, mark long, keys binary, texts binary")
    ranged = parsed.repartitionById(partitions(spark), "part").sortWithinPartitions("part", "host", "path", "page_id", "mark").select("part", "page_id", "url", "host", "keys", "texts")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pairing, before, now = zstandard.ZstdDecompressor(), None, None, None
        for batch in batches:
            for part, page, url, host, keys, texts in zip(*(batch.column(i) for i in range(6)), strict=True):
                pairing = pairing or Pairing(part.as_py())
                keys, host, page = unpack.decompress(keys.as_py()), host.as_py(), page.as_py()
                if now is None or host != now["host"] or keys != now["keys"]:
                    run = {"run": now["run"] + 1 if now else 0, "host": host, "keys": keys, "texts": split(unpack.decompress(texts.as_py()).decode(), unpacked(keys)), "pages": []}
                    if now:
                        yield from pairing.close(before, now, run)
                    before, now = now, run
                now["pages"].append((None if page == NO_ID else page, url.as_py()))
        if now:
            yield from pairing.close(before, now, None)
            for run in (before, now):
                if run and run["run"] > 1:
                    yield from pairing.end(run, False, run is now)
            yield pairing.made()

    paired = written(ranged.mapInArrow(pair, PAIRED), "paired", compression="zstd")
    # the nearest run that differs, back and ahead: four rows a task, in windows of their hosts
    met = paired.where("keys is not null").select("part", "run", "first", "last", "host", "keys", "texts")
    for name, by in (("back", W.partitionBy("host").orderBy("part", "run")), ("ahead", W.partitionBy("host").orderBy(F.desc("part"), F.desc("run")))):
        met = met.withColumn("next", F.lag("keys").over(by)).withColumn(name, F.last(F.when(F.col("next") != F.col("keys"), F.col("next")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, run, keys, texts, *beside in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                text, gone, shown = result(unpacked(keys), texts, [unpacked(n) for n in beside if n is not None])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([run], pa.int32()), pa.array([text]), pa.array([gone]), pa.array([shown])], names=["part", "run", "text", "n_shared", "n_named"])

    ends = met.where("first or last").select("part", "run", "keys", "texts", "back", "ahead").mapInArrow(meet, "part int, run int, text string, n_shared long, n_named long")
    out = ["page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_named"]
    members = paired.where("keys is null and part is not null").select("page_id", "url", "part", "run")
    return paired.where("part is null").select(*out).unionAll(members.join(ends, ["part", "run"]).select(*out))
