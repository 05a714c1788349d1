"""Periodic runs against a search of all lags of all places."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from helpers import odd_rows, rows
from perfmine.llm import periodic
from perfmine.llm.queries import QUERIES


def all_runs(words):
    """Every (start, length, period), by trying each period at each place."""
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                stretch = words[i : j + q]
                if not any(all(stretch[x] == stretch[x + p] for x in range(len(stretch) - p)) for p in range(1, q)):
                    out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_by_module(docs):
    words = np.concatenate([np.array(d, dtype=np.int64) for d in docs]) if docs else np.zeros(0, dtype=np.int64)
    lengths = [len(d) for d in docs]
    starts = np.cumsum([0, *lengths])
    found = periodic.runs_of(words, np.repeat(np.arange(len(docs)), lengths), np.repeat(starts[:-1], lengths))
    return [[(int(s - a), int(e - s), int(q)) for s, e, q in found if a <= s < b] for a, b in zip(starts, starts[1:], strict=False)]


def periodic_words(rng):
    out = []
    while len(out) < rng.randint(0, 250):
        block = [rng.randint(0, rng.choice([1, 3, 50])) for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 11, 12, 13, 24, 31]))]
        out += (block * rng.randint(1, 6))[: rng.randint(1, 200)]
        if rng.random() < 0.3 and out:
            out[rng.randrange(len(out))] = 99
    return out


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_those_of_all_lags(seed):
    rng = random.Random(seed)
    docs = [periodic_words(rng) for _ in range(6)]
    assert runs_by_module(docs) == [all_runs(d) for d in docs]


def test_fibonacci_words_and_powers():
    a, b = [0], [0, 1]
    while len(b) < 350:
        a, b = b, b + a
    docs = [b, [0] * 100, [0, 1] * 60, ([0, 0, 1] * 9 + [0]) * 4, [], [5]]
    assert runs_by_module(docs) == [all_runs(d) for d in docs]


def test_octaves_meet_at_their_borders():
    for q in (1, 5, 6, 7, 11, 12, 13, 23, 24, 25, 47, 48, 49, 96):
        block = list(range(q))
        doc = [1000] + (block * 13)[: max(12, 2 * q)] + [1001]
        assert runs_by_module([doc]) == [[(1, max(12, 2 * q), q)]]


def test_one_word_very_often_takes_little():
    started = time.time()
    assert runs_by_module([[0] * 300_000, [1, 2] * 50_000]) == [[(0, 300_000, 1)], [(0, 100_000, 2)]]
    assert time.time() - started < 60


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    greatest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *greatest, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    line = "again and again the same line of words"
    texts = [" ".join(f"w{x}" for x in periodic_words(rng)) for _ in range(60)] + ["\n".join([line] * 7), "x " * 40 + "y"]
    data = [r for r in odd_rows() if len(r[1] or "") < 20_000] + [(i + 100, *r[1:]) for i, r in enumerate(rows(texts))]
    docs = spark.createDataFrame(data, "doc_id long, text string, start string, runs string, period long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert got.columns == list(COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((brute(r[0], r[1]) for r in data), key=repr)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in data)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(none).count() == 0
