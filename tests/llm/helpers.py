"""Small documents with everything that tends to go wrong."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\t \r",
    "a",
    "%%% ### 12 34",
    "Straße und Übergröße, İstanbul ǅ",
    "don't we'll I'M they've x's ''s '",
    "tab\tand\x0bvertical\x0cfeed\x1cfile\x85next\xa0hard",
    "日本語のテキスト と emoji 😀😀 é Ωσς",
    "<|endoftext|> in <|startoftext|> the text <|endoftext|><|",
    "1234567890 3.14 ½ ² 1,000",
    "    four blanks   three\n\n\nlines ",
    "word " * 30_000,
    "a" * 50_000,
    "the the the and of",
    "All rights reserved. Licensed under CC BY-NC 4.0.",
]


def rows(texts, lang="en"):
    return [(i, t, lang, f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def odd_rows():
    """All odd texts, one of them twice, one row twice, and one without an id."""
    out = rows(ODD_TEXTS)
    return [*out, (len(out), ODD_TEXTS[13], "en", None, None), out[7], (None, "no id", None, None, None)]
