"""Token ids of whole texts by public tokenizer files, piece by piece through a bounded cache.

The tokenizers here never join characters across white space, except for the blank before a word, so that a
text's ids are those of its pieces in turn. Where that can't be shown for a piece (marks of special tokens,
unusual white space), the library encodes the whole text instead.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

from tokenizers import Tokenizer

from weftgraph.llm.common import KEPT

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism

CACHE = 1_000_000
_BLANK = " \t\n\x0b\x0c\r"
#: Letters that every Unicode version calls letters: a run of them that ends before another ASCII character or the
#: text's end is a token of its own in both patterns, so that punctuation doesn't multiply the pieces.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"  # not U+0130, which becomes two characters in lower case
_RUN = f"[{_LETTERS}]++" + r"(?=[\x00-@\[-`{-\x7f]|\Z)"
_SPACED = re.compile(rf" ?{_RUN}| ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_DROPPED = re.compile(rf"{_RUN}|[^{_BLANK}]+")
_ODD = re.compile("<\\||[\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


class _Whole(Exception):
    """The text has to be encoded whole."""


class Encoder:
    """``spaced``: blanks are part of tokens (byte-level BPE); else white space is dropped (word BPE)."""

    def __init__(self, path: str, spaced: bool, room: int = CACHE):
        self.tok, self.spaced = Tokenizer.from_file(path), spaced
        self.cache: dict[str, bytes] = {}
        self.room = room

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, pieces: list[str]) -> None:
        for p, e in zip(pieces, self.tok.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            if _ODD.search(p):
                raise _Whole
            self.cache[p] = array("I", e.ids).tobytes()

    def ids(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        cache = self.cache
        if len(cache) >= self.room:
            cache.clear()
        pieces = (_SPACED if self.spaced else _DROPPED).findall(text.decode())
        try:
            if new := set(pieces).difference(cache):
                self.learn(list(new))
            return b"".join(map(cache.__getitem__, pieces))
        except _Whole:
            return self.whole(text.decode())


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path, spaced)


KEPT.append(encoder.cache_clear)
