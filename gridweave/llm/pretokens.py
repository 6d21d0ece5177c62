"""Byte-level BPE ids through pre-token caches, for texts of any script.

A text is cut by the tokenizer's own pattern; each pre-token's ids come from a dictionary, and what is
missing there is encoded once and kept in the worker's cache. Plain texts (ASCII, Latin letters and common
punctuation) are cut by the standard library, others by the `regex` module, whose classes of letters,
numbers and white space are those of the tokenizer for every character assigned in the interpreter's own
Unicode version. Only texts with other characters, or with a special token's string, go whole through the
tokenizer's library, so ids are always its own.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Same cuts as the tokenizer's pattern, for texts made of PLAIN characters only.
CUTS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Anything else than ASCII, Latin letters and common punctuation: classes of those agree between regular-expression libraries.
OTHER = re.compile("[^\x00-\x1b\x20-\x7e¡¿À-ÖØ-öø-ɏ«»‘’“”–—…€]")
#: Bytes that a worker's cache holds before it starts anew, and the longest pre-token it keeps.
CACHE_BYTES, LONGEST = 64 << 20, 128
#: What an entry takes besides its own bytes.
ENTRY = 200


@cache
def unassigned() -> re.Pattern:
    """Characters whose class may differ between libraries of different Unicode versions."""
    spans: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c)) in ("Cn", "Cs"):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")


class Cache:
    """What was learnt of pre-tokens, within CACHE_BYTES; `fixed` stays when the table starts anew."""

    def __init__(self, fixed: dict | None = None):
        self.fixed, self.table, self.held = dict(fixed or {}), dict(fixed or {}), 0

    def learn(self, piece: str, value, size: int = 0) -> None:
        if len(piece) > LONGEST:
            return
        self.held += ENTRY + 4 * len(piece) + size
        if self.held > CACHE_BYTES:
            self.table.clear()
            self.table.update(self.fixed)
            self.held = ENTRY + 4 * len(piece) + size
        self.table[piece] = value


class Encoder:
    """The ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, json_path: str, ranks_path: str | None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.cuts = regex.compile(public_tokenizers.PATTERN)
        self.single = None
        if ranks_path and os.path.exists(ranks_path):
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.single = own.encode_ordinary
        self.cache = Cache()

    def library(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def cut(self, text: str) -> list[str] | None:
        """The pre-tokens of a text; None if only the library can tell."""
        if any(s in text for s in self.specials):
            return None
        if not OTHER.search(text):
            return CUTS.findall(text)
        return None if unassigned().search(text) else self.cuts.findall(text)

    def one(self, piece: str) -> list[int]:
        return self.single(piece) if self.single else self.library(piece)

    def known(self, piece: str) -> bytes:
        ids = self.cache.table.get(piece)
        if ids is None:
            ids = to_bytes(self.one(piece))
            self.cache.learn(piece, ids, len(ids))
        return ids

    def ids(self, text: str) -> bytes:
        pieces = self.cut(text)
        if pieces is None:
            return to_bytes(self.library(text))
        known = self.cache.table
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            return b"".join([self.known(p) for p in pieces])


def to_bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The worker's encoder for a file of the public tokenizers; it lives as long as the worker."""
    if name not in _ENCODERS:
        import public_tokenizers

        ranks = name.replace(".json", ".tiktoken")
        try:
            path = public_tokenizers.path(ranks)
        except Exception:  # noqa: BLE001  no such file: the library encodes every piece
            path = None
        _ENCODERS[name] = Encoder(public_tokenizers.path(name), path)
    return _ENCODERS[name]


def pieces(texts: Iterator[str | None], own: Encoder) -> Iterator[str]:
    for text in texts:
        yield from own.cut(text or "") or ()
