"""Fast cutting of plain Latin text into the pre-tokens of two public tokenizers.

The patterns below are the tokenizers' own, written out for a set of characters
whose classes (letter, number, space) are the same in every Unicode version.
A text with any other character, or with something that looks like a special
token, is left to the tokenizer library as a whole.
"""

from __future__ import annotations

import os
import re

# fixed values: letters and numbers among the plain characters
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
# fixed value: the contractions that both tokenizers cut off
_CUT = "'(?:s|t|re|ve|m|ll|d)"

_NOT_PLAIN = re.compile("[^\\t\\n\\r -~¡-¬®-įı-ɏ]|<\\|")

WORD_PIECES = re.compile(f"{_CUT}|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")
BYTE_PIECES = re.compile(f"{_CUT}| ?[{_L}]+| ?[{_N}]+| ?[^\\s{_L}{_N}]+|\\s+(?!\\S)|\\s+")

_LOADED: dict[str, object] = {}
_CACHES: dict[tuple, dict] = {}


# fixed values: bytes that byte-level tokenizers write as the character of the same number
_AS_IS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
# all others follow from U+0100 on
_BYTE_CHARS = {b: chr(b) for b in _AS_IS}
_BYTE_CHARS |= {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in _BYTE_CHARS)}


def byte_chars(piece: str) -> str:
    """The bytes of a pre-token without blanks, in the characters the merges are written in."""
    return piece if piece.isascii() else "".join(map(_BYTE_CHARS.__getitem__, piece.encode()))


def is_plain(text: str) -> bool:
    return _NOT_PLAIN.search(text) is None


def loaded_tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker process."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


class PieceCache(dict):
    """Pre-token -> value. Starts as the frequent table; misses are encoded and kept.

    When ``limit`` entries are reached, it falls back to the frequent table, so
    a worker's memory does not depend on the corpus.
    """

    def __init__(self, encode, frequent: dict, limit: int):
        super().__init__(frequent)
        self._encode, self._frequent, self._limit = encode, frequent, limit

    def __missing__(self, piece):
        if len(self) >= self._limit:
            self.clear()
            self.update(self._frequent)
        value = self[piece] = self._encode(piece)
        return value


def worker_cache(key: tuple, make) -> dict:
    """A cache that a worker process keeps from task to task."""
    if key not in _CACHES:
        _CACHES[key] = make()
    return _CACHES[key]
