"""Secrets: base patterns against plain regexes, the battery against plain arithmetic."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter

import pytest
from helpers import DOCS, odd_rows
from pyspark.sql import functions as F

from perfmine.llm import queries, secrets

PATTERNS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}


def brute(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            size = len(m.group(2)) if kind == "assign" else len(m.group())
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def made_texts(n):
    rnd = random.Random(2)
    bits = ["token", "Secret", "api_key", "APIKEY", "passwd", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "0a1b2c3d4e5f", "é", "😀", "x.y/z", "\n", "abcdefabcdef", "token:pw", "secret=token:abcdefgh"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(14))) for _ in range(n)]


def key(rnd, n, alphabet=string.ascii_letters + string.digits):
    return "".join(rnd.choice(alphabet) for _ in range(n))


def test_query_equals_brute_force(spark, tmp_path):
    docs = spark.createDataFrame([*odd_rows(), *[(500 + i, t, "en", "s", 1) for i, t in enumerate(made_texts(800))]], DOCS)
    docs.union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("doc_id", F.col("doc_id") + 2000)).write.parquet(f"{tmp_path}/documents.parquet")
    source = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    expected = []
    for r in source:
        spans = brute(r.text)
        places = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        expected.append((str(r.doc_id), *(sum(s[0] == k for s in spans) for k in PATTERNS), hashlib.sha256(places.encode()).hexdigest()))
    got = queries.op2_secret_scan(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(expected)
    assert sum(r[1] + r[2] + r[3] for r in expected) > 200


def test_random_runs_are_found_and_words_are_not(spark):
    rnd = random.Random(3)
    syllables = ["heit", "keit", "ung", "schaft", "lich", "ver", "ge", "bund", "wasser", "stoff", "ation", "ment"]
    rows, keys = [], {}
    for i in range(400):
        words = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(3, 9))) for _ in range(8)]
        if i % 8 == 0:
            keys[i] = key(rnd, rnd.choice([40, 48, 64]))
            words[rnd.randrange(8)] = keys[i]
        rows.append((i, "é " + " ".join(words) + " 20240506/20240507/20240508 ------------------------ aaaaaaaaaaaaaaaaaaaaaaaaaaaaa"))
    got = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = wrong = 0
    for i, text in rows:
        found = {text[a:b] for k, a, b in got[i] if k == "random"}
        right += keys.get(i) in found
        wrong += len(found - {keys.get(i)})
    assert right >= 0.85 * len(keys) and wrong <= 2


def plain(hit):
    for name, (pattern, alphabet, pair, triple) in secrets.ENCODINGS.items():
        if re.match(pattern, hit):
            break
    body = hit.rstrip("=")
    x = [alphabet.index(c) for c in (body.lower() if name == "hex" else body)]
    n, k = len(x), len(alphabet)
    tail = lambda z: math.erfc(z / 2**0.5) / 2
    chi = sum((c - n / k) ** 2 / (n / k) for c in Counter(x).values()) + (k - len(set(x))) * n / k
    free, mid = k - 1, (k - 1) / 2
    z_chi = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / (2 / (9 * free)) ** 0.5
    signs = [v > mid for v in x]
    runs, above = 1 + sum(a != b for a, b in zip(signs, signs[1:])), sum(signs)
    mean = 2 * above * (n - above) / n + 1
    z_runs = abs(runs - mean) / ((mean - 1) * (mean - 2) / (n - 1)) ** 0.5 if mean > 2 else 10.0
    z_serial = abs(sum((a - mid) * (b - mid) for a, b in zip(x, x[1:]))) / ((k * k - 1) / 12 * (n - 1) ** 0.5)
    p_random = min(1, 3 * min(tail(z_chi), 2 * tail(z_runs), 2 * tail(z_serial)))
    expected = k + k * (n - 1) * pair - n
    spread = k / n * (2 * n * (n - 1) * pair * (1 - pair) + 4 * n * (n - 1) * (n - 2) * (triple - pair * pair)) ** 0.5
    return name, n, p_random, tail((expected - chi) / spread)


def test_battery_equals_plain_arithmetic(spark):
    rnd = random.Random(5)
    hits = [key(rnd, rnd.randrange(20, 90), a) for a in ("0123456789abcdef", string.ascii_uppercase + "234567", string.ascii_letters + string.digits, string.ascii_letters + "+/", string.ascii_letters + "-_", string.ascii_lowercase, "ab", "a") for _ in range(20)]
    hits += [h + "==" for h in hits[30:60]]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hits)], "row long, hit string")
    got = {r.row: r for r in secrets.tested(df).collect()}
    for i, h in enumerate(hits):
        name, n, p_random, p_text = plain(h)
        assert (got[i].encoding, got[i].n) == (name, n)
        assert got[i].p_random == pytest.approx(p_random, abs=1e-6) and got[i].p_text == pytest.approx(p_text, abs=1e-6)


ALPHABETS = {
    "decimal": string.digits,
    "hex": "0123456789abcdef",
    "lower": string.ascii_lowercase,
    "upper": string.ascii_uppercase,
    "base32": string.ascii_uppercase + "234567",
    "base32lower": string.ascii_lowercase + "234567",
    "loweralnum": string.ascii_lowercase + string.digits,
    "upperalnum": string.ascii_uppercase + string.digits,
    "letters": string.ascii_letters,
    "alnum": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/",
    "base64url": string.ascii_letters + string.digits + "-_",
}


def test_recall_of_every_encoding_and_length(spark):
    rnd = random.Random(17)
    keys = [(name, n, key(rnd, n, a)) for name, a in ALPHABETS.items() for n in (48, 64, 100, 200, 400) for _ in range(60)]
    df = spark.createDataFrame([(i, k) for i, (_, _, k) in enumerate(keys)], "row long, hit string")
    tested = secrets.tested(df).cache()
    passed = {r.row for r in tested.where(F.col("p_random") >= secrets.LEAST_P).collect()}
    found = {r.row for r in secrets.discovered(tested).collect()}
    for name in ALPHABETS:
        for n in (48, 64, 100, 200, 400):
            own = {i for i, (e, m, _) in enumerate(keys) if (e, m) == (name, n)}
            assert len(own & passed) >= 0.9 * len(own), (name, n)
            # the smaller the alphabet, the longer is a key that can be told from text in it
            if n >= {"decimal": 200, "hex": 100, "lower": 100, "upper": 100}.get(name, 64):
                assert len(own & found) >= 0.85 * len(own), (name, n)


def test_runs_of_both_alphabets_are_tested_in_pieces(spark):
    rnd = random.Random(18)
    rows, keys = [], {}
    for i in range(120):
        if i % 2:
            own = "x_" + key(rnd, 60, ALPHABETS["base64url"])
            text = f"é see https://host.example/reset-password/{own} now"
        else:
            own = key(rnd, 30, ALPHABETS["base64"]) + "+/" + key(rnd, 30, ALPHABETS["base64"])
            text = f"é use sk-live-{own}== now"
            own += "=="
        keys[i] = own
        rows.append((i, text))
    rows += [(200 + i, "é see /some-long-directory-name/of_common_words/with-more-of-the-same/and_nothing-else") for i in range(60)]
    got = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {i: [t[s["start"] : s["end"]] for s in got[i]] for i, t in rows}
    assert sum(keys[i] in found[i] for i in keys) >= 0.85 * len(keys)
    assert not any(found[i] for i, _ in rows if i >= 200)
    for i in keys:  # none inside another
        places = [(s["start"], s["end"]) for s in got[i]]
        assert not any(p != q and p[0] <= q[0] and q[1] <= p[1] for p in places for q in places)


def test_step_up_control(spark):
    rnd = random.Random(7)
    runs = [(float(rnd.choice([20, 40, 100])), 10 ** -rnd.uniform(0, 1.5) if rnd.random() < 0.7 else 10 ** -rnd.uniform(2, 9)) for _ in range(600)]
    df = spark.createDataFrame([(i, n, p, 1.0 if i % 5 else 0.0) for i, (n, p) in enumerate(runs)], "row long, n double, p_text double, p_random double")
    got = {r.row for r in secrets.discovered(df, 0.05).collect()}
    expected = set()
    for size in {int(math.log2(n)) for n, _ in runs}:
        own = sorted((10 ** (-math.floor(-math.log10(p) * 20) / 20), i) for i, (n, p) in enumerate(runs) if int(math.log2(n)) == size)
        count = max((k + 1 for k, (p, _) in enumerate(own) if p * len(own) <= 0.05 * (k + 1)), default=0)
        limit = own[count - 1][0] if count else -1
        expected |= {i for p, i in own if p <= limit and i % 5}
    assert got == expected and len(got) > 50


def test_normal_tail(spark):
    z = [-6.0, -1.5, 0.0, 0.3, 2.0, 7.5]
    got = spark.createDataFrame([(v,) for v in z], "z double").select("z", secrets.normal_tail(F.col("z")).alias("p")).collect()
    assert all(r.p == pytest.approx(math.erfc(r.z / 2**0.5) / 2, abs=2e-7) for r in got)


def test_odd_and_empty_input(spark):
    odd = spark.createDataFrame(odd_rows(), DOCS).withColumns({c: F.lit("x") for c in ("row", "spans", "kind", "start", "parts", "n")})
    assert secrets.find_secrets(odd).count() == len(odd_rows())
    assert secrets.find_secrets(spark.createDataFrame([], DOCS)).count() == 0


def test_the_plan_has_no_python(spark):
    plan = secrets.find_secrets(spark.createDataFrame(odd_rows(), DOCS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(Eval|Map)|MapIn", plan)
