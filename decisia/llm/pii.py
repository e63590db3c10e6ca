"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus-signs, schemes and identifier cues in one pass over a text; a local parser
at each anchor expands to both sides and validates. Digit groups (network addresses, card numbers) have no anchor but their
own first digit and are found by their runs. Every parser is linear in the text and no text is cut.

Base kinds, leftmost non-overlapping within a kind, in code points: email, ip (four parts up to 255), card (16 to 19 digits
that pass Luhn), phone (8 to 15 digits after a plus). Added by the method: account (a cue, then a number with at least six
digits, or an IBAN that passes its check), secret (a cue such as token or password, then a value of 16 characters or more
with both letters and digits), url (a scheme and what follows it). Cases: null and empty texts have no spans; repeated rows
give repeated results; extra columns are left out. No shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisia.llm.common import text_of

KINDS = ("email", "ip", "card", "phone", "account", "secret", "url")
OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

# The cues after which an identifier or a secret stands.
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "cuenta", "compte", "ssn", "passport", "routing", "customer id", "tax id")
SECRET_CUES = ("token", "api_key", "apikey", "api key", "secret", "password", "passwd", "access_key", "private_key")
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "mailto:", "ssh://")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ACCOUNT = re.compile(r"[^A-Za-z0-9\n]{0,6}(?:(?:no|number|nr|num|id|is)\b[^A-Za-z0-9\n]{0,6})?([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){2,8}|[0-9](?:[\x20-]?[0-9]){5,33})", re.I)
SECRET = re.compile(r"\x20{0,3}[=:]\x20{0,3}[\"']?([A-Za-z0-9_+/.~-]{16,})")
URL = re.compile(r"[^\x00-\x20\"'<>`|]+")


@functools.cache
def automaton():
    """Anchors and what stands there; a cue in lower, upper and title case."""
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("url", SCHEMES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.title(), cue.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def iban(code: str) -> bool:
    code = code.replace(" ", "").upper()
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def email_at(text: str, at: int, least: int) -> tuple[int, int] | None:
    """The address around an at-sign, whose local part starts at least or later."""
    domain = DOMAIN.match(text, at + 1)
    if not domain:
        return None
    start = at
    while start > least and text[start - 1] in LOCAL:
        start -= 1
    return (start, domain.end()) if start < at else None


def anchored(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    end = dict.fromkeys(KINDS, 0)
    for last, (kind, length) in automaton().iter(text):
        at, after = last + 1 - length, last + 1
        span = None
        if kind == "email":
            span = email_at(text, at, end[kind])
        elif at < end[kind]:
            continue
        elif kind == "phone":
            if m := PHONE.match(text, at):
                end[kind] = m.end()
                span = m.span() if 8 <= sum(c.isdigit() for c in m[0]) <= 15 else None
        elif kind == "url":
            if m := URL.match(text, after):
                stop = after + len(m[0].rstrip(".,;:!?)]}"))
                span = (at, stop) if stop > after else None
        elif at and text[at - 1].isalnum():
            continue
        elif kind == "account":
            m = ACCOUNT.match(text, after)
            if m and (iban(m[1]) if m[1][0].isalpha() else True):
                span = m.span(1)
        elif (m := SECRET.match(text, after)) and re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1]):
            span = m.span(1)
        if span:
            found[kind].append(span)
            end[kind] = span[1]
    return found


def spans_of(text: str) -> dict[str, list[tuple[int, int]]]:
    """All spans of a text, by kind, in order of their starts."""
    found = anchored(text)
    for m in DOTTED.finditer(text):
        parts, start = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            stop = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:] or 0) <= 255 for p in four):
                found["ip"].append((start, stop))
            start = stop + 1
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    return found


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as kind:start:end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column(1):
                found = spans_of(text.as_py())
                for col, kind in zip(cols, KINDS[:4], strict=False):
                    col.append(len(found[kind]))
                cols[4].append(hashlib.sha256(joined(found, KINDS[:4]).encode()).hexdigest())
                cols[5].append(joined(found, KINDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=[x.split()[0] for x in OUT.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, OUT)
