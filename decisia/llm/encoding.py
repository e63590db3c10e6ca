"""Token ids of whole texts by a public tokenizer file, one core a task, in bounded memory."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import regex

from decisia.llm.memory import thrifty

thrifty()

#: Code points encoded in one call, and pieces kept in the cache of one worker process.
CHUNK_CHARS, CACHED_PIECES = 1_000_000, 500_000

#: Splits a text as byte-level BPE with its usual pattern does; ids of a text are the ids of its parts in turn.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: White space but the plain space and the line feed, for which a text is cut by PARTS alone.
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
UNCUT = ("  ", " \n", "\n ", "\0", *OTHER_SPACE)


class Pieces(dict):
    """Ids of pieces met so far, as little-endian unsigned 32-bit bytes; a new piece is put together from its parts, a new part encoded."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.model = tokenizer.model
        self.ids = [int(i).to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED_PIECES:
            self.clear()
        head = piece[:-1]
        if piece.isalpha() or piece[:1] == " " and piece[1:].isalpha():
            found = self._part(piece)
        elif piece[-1:] in (".", ",") and (head.isalpha() or head[:1] == " " and head[1:].isalpha()):
            found = self[head] + self[piece[-1]]
        elif len(parts := PARTS.findall(piece)) > 1:
            found = b"".join([self[p] for p in parts])
        else:
            found = self._part(piece)
        self[piece] = found
        return found

    def _part(self, part: str) -> bytes:
        ids = self.ids
        return b"".join([ids[t.id] for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))])


class Encoder:
    """Encodes with the tokenizers library. A special token's string in a text becomes its id, as the library does unless told
    otherwise; with special=False it is ordinary text.

    Where the file asks for byte-level BPE and nothing beyond, texts are cut at added tokens and before spaces, where no part of
    PARTS goes on, and pieces that come again cost one look-up. Any other tokenizer encodes the texts whole.
    """

    def __init__(self, path: str, special: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        spec = json.loads(self.tokenizer.to_str())
        added = [t for t in spec.get("added_tokens") or () if special or not t["special"]]
        self.pieces = Pieces(self.tokenizer) if self._by_pieces(spec, added) else None
        self.added = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in added}
        self.cut_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None

    @staticmethod
    def _by_pieces(spec: dict, added: list[dict]) -> bool:
        pre = spec.get("pre_tokenizer") or {}
        plain = spec["model"]["type"] == "BPE" and not spec["model"].get("byte_fallback") and spec.get("normalizer") is None
        alone = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        return plain and alone and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", False)

    def _cut(self, text: str) -> list[str]:
        if any(x in text for x in UNCUT):
            return PARTS.findall(text)
        # single line feeds are parts; of several in a row PARTS decides
        lines = text if "\n\n" in text else text.replace("\n", "\0\n\0")
        return lines.replace(" ", "\0 ").split("\0")

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        if self.pieces is None:
            return [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        get, out = self.pieces.__getitem__, []
        for text in texts:
            if any(x in text for x in self.added):
                found = [self.added[x] if k % 2 else b"".join(map(get, self._cut(x))) for k, x in enumerate(self.cut_added.split(text))]
            else:
                found = map(get, self._cut(text))
            out.append(np.frombuffer(b"".join(found), dtype="<u4"))
        return out

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text in turn."""
        waiting: list[str] = []
        size = 0
        for text in texts:
            waiting.append(text)
            size += len(text)
            if size >= CHUNK_CHARS:
                yield from self._chunk(waiting)
                waiting, size = [], 0
        if waiting:
            yield from self._chunk(waiting)


@functools.lru_cache(maxsize=2)
def encoder(path: str, special: bool = True) -> Encoder:
    return Encoder(path, special)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies; pass another path to the operators to use one of your own."""
    import public_tokenizers

    return public_tokenizers.path(name)
