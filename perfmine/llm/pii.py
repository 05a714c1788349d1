"""Personal data: fixed patterns, and spans that a semi-Markov random field adds.

The patterns find e-mail addresses, IP addresses, payment cards and telephone
numbers in fixed forms. The field looks at the stretches of text that hold an at
sign or many digits and finds the forms that the patterns do not know, such as
local telephone numbers and addresses in other scripts. It is trained here, on
made-up examples, and always the same.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfmine.llm.common import arrow_map, id_and_text
from perfmine.llm.crf import MOST_ATOMS, Candidate, SemiMarkovField, candidates_of, fit

KINDS = ("email", "ip", "card", "phone")
#: A span is added if its probability is at least this.
SURE = 0.9
#: Code points before and after an at sign.
_BEFORE, _AFTER = 64, 128
#: Digits of a number, and groups it may be written in.
LEAST_DIGITS, MOST_DIGITS, MOST_GROUPS = 7, 19, 5

# fixed values: the base patterns
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign outwards, so that long words without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, in code points."""
    found = [("email", *span) for span in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = digits_of(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return found


_DIGIT = re.compile("[0-9]")
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)
#: Runs of digits and what stands between the groups of a number.
_NUMBERS = re.compile(r"[+(]?[0-9](?:[0-9]|[ ().+-]{1,3}(?=[0-9]))*")
_PHONE_WORDS = frozenset("tel phone telephone call fax mobile cell telefon appel llame handy ruf".split())
_CARD_WORDS = frozenset("card visa mastercard amex credit debit karte carte tarjeta".split())
_OTHER_WORDS = frozenset("order id no nr number version isbn issn invoice ref page lines rows year total sum eur usd part item".split())


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Where the field looks: around at signs, and runs of numbers with seven digits or more."""
    at, done = text.find("@"), 0
    while at >= 0:
        after = text.find("@", at + 1)
        low, high = at, at + 1
        while low > max(done, at - _BEFORE) and not text[low - 1].isspace():
            low -= 1
        stop = min(len(text) if after < 0 else after, at + _AFTER)
        while high < stop and not text[high].isspace():
            high += 1
        yield low, high
        at, done = after, at + 1
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() >= LEAST_DIGITS and len(digits_of(m.group())) >= LEAST_DIGITS:
            yield m.span()


def plausible(atoms: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of atoms that can be an entity by their size: around the at sign, or a number of few groups."""
    at = atoms.index("@") if "@" in atoms else None
    for begin, first in enumerate(atoms):
        if not (first[0].isalnum() or first in "+("):
            continue
        if at is not None:
            if begin < at:
                yield from ((begin, end) for end in range(at + 2, min(len(atoms), begin + MOST_ATOMS) + 1))
            continue
        digits = groups = 0
        for end in range(begin, min(len(atoms), begin + MOST_ATOMS)):
            if atoms[end][0].isdigit():
                digits, groups = digits + len(atoms[end]), groups + 1
                if digits > MOST_DIGITS or groups > MOST_GROUPS:
                    break
                if digits >= LEAST_DIGITS:
                    yield begin, end + 1


def _word_before(text: str, start: int) -> str:
    words = re.findall(r"[^\W\d_]+", text[max(0, start - 24) : start].lower())
    return words[-1] if words else ""


def _context(word: str) -> str:
    for name, words in (("phone", _PHONE_WORDS), ("card", _CARD_WORDS), ("other", _OTHER_WORDS)):
        if word in words:
            return name
    return "none"


def describer(before: str):
    """Features of the spans of one stretch; ``before`` is the word in front of it."""
    context = _context(before)

    def describe(atoms: list[str], begin: int, end: int) -> dict[str, tuple[str, ...]]:
        first, last = atoms[begin], atoms[end - 1]
        if not last[-1].isalnum() or not (first[0].isalnum() or first in "+("):
            return {}
        span = atoms[begin:end]
        edges = [
            f"left={_edge(atoms[begin - 1][-1]) if begin else 'none'}",
            f"right={_edge(atoms[end][0]) if end < len(atoms) else 'none'}",
        ]
        if span.count("@") == 1:
            at = span.index("@")
            local, domain = span[:at], span[at + 1 :]
            if not local or not domain or not _plain_parts(local, "._%+-") or not _plain_parts(domain, ".-"):
                return {}
            facts = ["bias", f"dots={min(2, domain.count('.'))}", f"top={domain[-1].isalpha() and len(domain[-1]) >= 2}", *edges]
            return {"email": tuple(f"email:{f}" for f in facts)}
        groups = [len(a) for a in span if a[0] in "0123456789"]
        n = sum(groups)
        if not LEAST_DIGITS <= n <= MOST_DIGITS or any(a[0].isalpha() or a in "@_%" for a in span):
            return {}
        between = {a for a in span if not a[0].isdigit()} - {"+"}
        facts = [
            "bias",
            f"groups={'-'.join(map(str, groups))}",
            f"n={n}",
            f"plus={first == '+'}",
            f"round={'(' in span and ')' in span}",
            f"between={''.join(sorted(between - set('()')))}",
            f"context={context if begin == 0 else 'inside'}",
            *edges,
        ]
        out = {}
        if n <= 15:
            out["phone"] = tuple(f"phone:{f}" for f in facts)
        if n >= 12 and between <= {" ", "-"}:
            out["card"] = tuple(f"card:{f}" for f in [*facts, f"luhn={luhn(digits_of(''.join(span)))}"])
        return out

    return describe


def _edge(char: str) -> str:
    return "digit" if char.isdigit() else "letter" if char.isalpha() else "blank" if char.isspace() else "mark"


def _plain_parts(atoms: list[str], marks: str) -> bool:
    """Words and marks in turn, beginning and ending with a word."""
    return all(a[0].isalnum() if k % 2 == 0 else a in marks for k, a in enumerate(_merged(atoms)))


def _merged(atoms: list[str]) -> list[str]:
    out: list[str] = []
    for a in atoms:
        if out and a[0].isalnum() and out[-1][0].isalnum():
            out[-1] += a
        else:
            out.append(a)
    return out if len(out) % 2 else [*out, " "]


def made_up_examples(n: int = 700, seed: int = 20) -> list[tuple[str, str, list[tuple[str, int, int]]]]:
    """(text, word before, true spans): entities in many forms among numbers of other kinds."""
    rnd = random.Random(seed)
    number = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice("abcdefghilmnoprstuéüñ") for _ in range(rnd.randrange(3, 9)))

    def card() -> str:
        while True:
            digits = rnd.choice("3456") + number(rnd.choice((15, 15, 15, 14)))
            if luhn(digits):
                sep = rnd.choice(("", " ", "-"))
                return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rnd.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{number(2)} {number(3)} {number(7)}", f"1-{a}-{b}-{c}"))

    def other() -> str:
        y, m, d = number(4), number(2), number(2)
        return rnd.choice(
            (number(16), number(16), number(12), number(8), number(10), f"{y}-{m}-{d}", f"{y}-{m}-{d} {number(2)}", f"{number(1)}.{number(6)}", f"{y} {y} {y} {y} {y}",
             f"{number(3)} {number(5)} {number(2)}", f"{number(4)}-{number(4)}", f"{number(2)} {number(2)} {number(2)} {number(2)}", f"{number(3)}.{number(3)}.{number(3)}", f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}")
        )

    out = []
    for k in range(n):
        kind = ("email", "phone", "card", "other", "other", "other")[k % 6]
        if kind == "email":
            name = rnd.choice((word(), f"{word()}.{word()}", f"{word()}{number(2)}", f"{word()}_{word()}"))
            body = f"{name}@{rnd.choice((word(), f'mail{number(1)}.{word()}', f'{word()}-{word()}'))}.{rnd.choice(('com', 'de', 'org', 'example'))}"
            if rnd.random() < 0.2:
                body, kind = rnd.choice((f"@{word()}", f"{word()}@", f"{word()}@{word()}", f"{number(2)}@{number(1)}.{number(2)}")), "other"
        else:
            body = {"phone": phone, "card": card, "other": other}[kind]()
        left, right = rnd.choice(("", "", "(", '"')) if kind == "email" else "", rnd.choice(("", "", ".", ",", "!"))
        known = {"phone": sorted(_PHONE_WORDS), "card": sorted(_CARD_WORDS), "other": sorted(_OTHER_WORDS)}.get(kind, [word()])
        before = rnd.choice(known) if rnd.random() < 0.4 else word()
        # a text ends a stretch of numbers itself; around an at sign the marks belong to it
        text = left + body + (right if "@" in body else "")
        out.append((text, before, [] if kind == "other" else [(kind, len(left), len(left) + len(body))]))
    return out


@lru_cache(maxsize=1)
def trained_field() -> SemiMarkovField:
    examples = []
    for text, before, spans in made_up_examples():
        atoms, starts = cut(text)
        candidates = candidates_of(atoms, plausible(atoms), describer(before))
        places = [(c.kind, starts[c.begin], starts[c.end]) for c in candidates]
        examples.append((len(atoms), candidates, {k for k, p in enumerate(places) if p in spans}))
    return fit(examples)


def cut(text: str) -> tuple[list[str], list[int]]:
    """Atoms and where each begins, with the end of the last."""
    atoms = _ATOM.findall(text)
    starts = [0]
    for a in atoms:
        starts.append(starts[-1] + len(a))
    return atoms, starts


def added_spans(text: str, base: list[tuple[str, int, int]], field: SemiMarkovField) -> list[tuple[str, int, int]]:
    """Spans that the field is sure of; one that meets a base span must hold all of it and more."""
    found = []
    # the spans of one kind do not overlap, so their starts and ends both rise
    places = [([s for k, s, _ in base if k == kind], [e for k, _, e in base if k == kind]) for kind in KINDS]
    for low, high in stretches(text):
        inside = [
            (starts[i], ends[i]) for starts, ends in places if starts for i in range(bisect_right(ends, low), bisect_left(starts, high))
        ]
        if any(s <= low and high <= e for s, e in inside):
            continue
        atoms, starts = cut(text[low:high])
        candidates = candidates_of(atoms, plausible(atoms), describer(_word_before(text, low)))
        if not candidates:
            continue
        sure = field.posteriors(len(atoms), candidates)
        for k in field.best(len(atoms), candidates):
            c: Candidate = candidates[k]
            start, end = low + starts[c.begin], low + starts[c.end]
            met = [(s, e) for s, e in inside if s < end and e > start]
            if sure[k] >= SURE and all(start <= s and e <= end and (s, e) != (start, end) for s, e in met):
                found.append((c.kind, start, end))
    return found


def spans_of(text: str, field: SemiMarkovField) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by start, then kind in the order of ``KINDS``."""
    base = base_spans(text)
    added = added_spans(text, base, field) if base or "@" in text or _DIGIT.search(text) else []
    rows = [(*s, True) for s in base] + [(*s, False) for s in added]
    return sorted(rows, key=lambda r: (r[1], KINDS.index(r[0]), r[2], not r[3]))


def redact(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with every span replaced by its kind; spans that overlap become one, named by the first."""
    out, done = [], 0
    for kind, start, end, _ in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, redacted) of every row.

    ``spans`` holds (kind, start, end, base) in code points, end exclusive, sorted
    by start; ``redacted`` is the whole text with the spans replaced. A null text
    is empty. A null id is kept, repeated rows are searched each. Work is linear
    in the length of a text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained_field())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [spans_of(t, shared.value) for t in texts]
            yield {
                "doc_id": batch.column(0),
                "spans": [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans] for spans in found],
                "redacted": [redact(t, spans) if spans else t for t, spans in zip(texts, found, strict=True)],
            }

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>, redacted string"
    return arrow_map(id_and_text(docs, id_col, text_col), work, schema)


def redacted_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars`` counted anew; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(trained_field())

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else redact(t, spans_of(t, shared.value)))

    return docs.withColumn("text", replaced("text")).withColumn("n_chars", F.length("text").cast("long"))
