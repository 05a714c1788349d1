"""Words of a text: runs of digits, letters and everything beyond ASCII, with A-Z folded."""

from __future__ import annotations

# fixed values: what separates words, and letters in either case
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(_SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(_SEPARATORS) + bytes(range(0x61, 0x7B)))


def folded_words(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()
