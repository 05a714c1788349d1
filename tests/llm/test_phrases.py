"""Collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from helpers import odd_rows
from perfmine.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(data, least, top):
    """``data`` is (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in data:
        lang = lang or "und"
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            inside = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 50 * a for b in inside):
                rows.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows[:top])]
    return sorted(out)


def made(rng, docs, vocabulary):
    out = []
    for _ in range(docs):
        words = [rng.choice(vocabulary) if rng.random() < 0.7 else "New York times" for _ in range(rng.randint(0, 60))]
        out.append((rng.choice([" ", "  ", "\t"]).join(words).replace("q", rng.choice([".", "\n", "q;"])), rng.choice(["en", "de", None, "und"])))
    return out


@pytest.mark.parametrize(("seed", "share", "small", "portion"), [(0, 4096, 200, 10**6), (1, 4096, 2, 40), (2, 30, 2, 40), (3, 5, 0, 300)])
def test_equals_plain_counts(spark, monkeypatch, seed, share, small, portion):
    # few places make a word very frequent, small portions and partitions make all paths run
    monkeypatch.setattr(phrases, "FREQUENT_SHARE", share)
    monkeypatch.setattr(phrases, "SMALL", small)
    monkeypatch.setattr(phrases, "PORTION_WORDS", portion)
    rng = random.Random(seed)
    data = made(rng, 80, ["a", "B", "c", "ünter", "É", "q", "d-e", "x y", "\x1c", "z" * 40])
    docs = spark.createDataFrame(data, "text string, lang string").repartition(3)
    least, top = (10, 2000) if seed < 2 else (3, 7)
    got = phrases.collocations(docs, least, top)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(data, least, top)


def test_sorting_counts_every_prefix(monkeypatch):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 6, (5000, 3))
    ids[ids[:, 1] == 0, 2] = 0
    n = rng.integers(1, 4, 5000)
    expected = Counter()
    for row, w in zip(ids.tolist(), n.tolist(), strict=True):
        for k in range(3):
            if not row[k]:
                break
            expected[tuple(row[: k + 1])] += w
    expected = {p: w for p, w in expected.items() if w >= 50}
    for small in (0, 3, 700, 10_000):
        monkeypatch.setattr(phrases, "SMALL", small)
        rows = [(tuple(w for w in row if w), int(n)) for prefixes, weights in phrases.sorted_counts(ids, n, 50) for row, n in zip(prefixes.tolist(), weights, strict=True)]
        assert len(rows) == len(expected) and dict(rows) == expected


def test_words_of_a_part_are_numbered_alike_however_many_there_are():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 50, (40, 3)), rng.integers(1, 50, (7, 3)), rng.integers(0, 9, (1, 3))):
        for size in (50, 10**6):
            used, local = phrases.numbered_anew(ids, size)
            assert used.tolist() == sorted(set(ids.ravel().tolist()) - {0})
            assert (np.concatenate([[0], used])[local] == ids).all()


def test_rows_of_many_parts_are_sent_together(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(phrases, "arrow_map", lambda df, work, schema: sent.append(work))
    words = [f"w{i}" for i in range(40)]
    texts = spark.createDataFrame([("en", " ".join(words * 3))], "lang string, text string")
    phrases.routed(texts, np.full(phrases.FILTER_BITS // 64, 2**64 - 1, dtype=np.uint64), {("en", "w3")}, 30)
    batches = list(sent[0](iter(texts.toArrow().to_batches())))
    assert len(batches) == 1 and len(batches[0]["part"]) == len(set(batches[0]["part"])) > 10


def test_products_beyond_64_bits(spark):
    a = 3_000_000_000_000
    row = spark.sql(f"select 1000000 * (cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))) div (cast({a + 1} as decimal(18,0)) * cast({a} as decimal(18,0)))").first()
    assert row[0] == 10**6 * a * a // ((a + 1) * a)


def test_odd_texts_repeated_rows_clashing_columns_and_an_empty_table(spark):
    data = [r for r in odd_rows() for _ in range(6)] + [(7, "of the " * 9 + "END", None, "s", 1)]
    docs = spark.createDataFrame(data, "n long, text string, lang string, phrase string, f long")
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == brute([(r[1], r[2]) for r in data], 10, 2000)
    assert phrases.collocations(docs.limit(0)).count() == 0
