"""Repeated byte strings against a count of all strings."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from helpers import odd_rows
from perfmine.llm import suffixes
from perfmine.llm.queries import QUERIES


def brute(texts, length):
    texts = [(t or "").encode() for t in texts]
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [9, 20, 50, 400, 3000])
def test_cover_has_every_difference(length):
    v, cover = suffixes.difference_cover(length)
    assert v <= 0.8 * length
    assert {(int(a) - int(b)) % v for a in cover for b in cover} == set(range(v))


def test_no_cover_for_very_short_strings():
    with pytest.raises(ValueError):
        suffixes.difference_cover(8)


def test_steps_come_back():
    for values in ([], [0], [5, 6, 70_000, 70_001, 4_000_000_000]):
        assert suffixes.unpacked_steps(suffixes.packed_steps(np.array(values, dtype=np.int64))).tolist() == values


def test_names_that_share_64_bits_are_told_apart():
    high, low = np.array([7, 7, 7, 3], dtype=np.uint64), np.array([1, 2, 1, 1], dtype=np.uint16)
    order, first = suffixes.ranked(high, low)
    assert sorted(Counter(np.cumsum(first).tolist()).values()) == [1, 1, 2] and len(order) == 4


def made_texts(rng, n, alphabet="ab"):
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.5:
            a, b = rng.choice(texts) or "", rng.choice(texts) or ""
            i, j = sorted((rng.randint(0, len(a)), rng.randint(0, len(a))))
            texts.append(b[: rng.randint(0, len(b))] + a[i:j] + "é" * rng.randint(0, 2))
        else:
            texts.append("".join(rng.choices(alphabet, k=rng.randint(0, 120))))
    return [*texts, None, "", "x" * 70]


@pytest.mark.parametrize(("seed", "portion", "length"), [(0, 50, 12), (1, 50, 20), (2, 1_000_000, 20)])
def test_equals_brute_force(spark, monkeypatch, seed, portion, length):
    # small portions cut texts in two and make strings meet in other tasks
    monkeypatch.setattr(suffixes, "PORTION_PLACES", portion)
    rng = random.Random(seed)
    texts = made_texts(rng, 60, "ab" if seed else "abcdefgh")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r[0]: tuple(r)[1:5] for r in suffixes.without_repeats(docs, length).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_removed_runs_make_the_counts(spark):
    docs = spark.createDataFrame([(1, "q" * 30), (2, "abcdefghijklmnop"), (3, "--abcdefghijklmnop--"), (3, "z")], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): [tuple(s) for s in r.removed] for r in suffixes.without_repeats(docs, 12).collect()}
    assert got == {(1, 30): [(0, 30)], (2, 16): [(0, 16)], (3, 20): [(2, 18)], (3, 1): []}


def test_query_on_odd_texts_repeated_rows_and_clashing_columns(spark, tmp_path):
    rng = random.Random(3)
    passage = "".join(rng.choices("abcdefg hij", k=700))
    extra = ["".join(rng.choices("klmnop", k=300)) + passage[k : k + 401] for k in (0, 299, 40)] + [passage[:399], passage[1:400] + "!"]
    data = [r for r in odd_rows() if len(r[1] or "") < 20_000] + [(100 + k, t, "en", "s", 1) for k, t in enumerate(extra)]
    spark.createDataFrame(data, "doc_id long, text string, fp string, places string, hint long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_suffix_dedup"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    expected = [(r[0], *b) for r, b in zip(data, brute([r[1] for r in data], 400), strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.without_repeats(none).count() == 0
