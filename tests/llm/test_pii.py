"""Personal data: base patterns against plain regexes, the field against all segmentations."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time

import pytest
from helpers import DOCS, odd_rows
from pyspark.sql import functions as F

from perfmine.llm import pii, queries
from perfmine.llm.crf import Candidate, SemiMarkovField, fit

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(d) * 2 if k % 2 else int(d) for k, d in enumerate(digits[::-1])]
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def random_texts(n):
    rnd = random.Random(1)
    alphabet = ["1", "2", "0", "9", "25", ".", ".", " ", "-", "+", "(", ")", "@", "a", "b.c", "@x.y", "é", "4952935900253052", "\n"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30))) for _ in range(n)]


def test_base_spans_equal_the_patterns():
    for text in [*random_texts(6000), "1.2.3.4.5.6.7.8", "a@b.c@d.e", "a@@b.c", "x@y..z@q.r", "+1+2345678901", "0000001.2.3.4"]:
        mine = sorted(pii.base_spans(text), key=lambda s: (s[1], pii.KINDS.index(s[0])))
        assert mine == brute(text), text


def test_query_equals_brute_force(spark, tmp_path):
    docs = spark.createDataFrame([*odd_rows(), *[(500 + i, t, "en", "s", 1) for i, t in enumerate(random_texts(300))]], DOCS)
    docs.union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000)).write.parquet(f"{tmp_path}/documents.parquet")
    source = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    expected = []
    for r in source:
        spans = brute(r.text)
        places = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        expected.append((str(r.doc_id), *(sum(s[0] == k for s in spans) for k in PATTERNS), hashlib.sha256(places.encode()).hexdigest()))
    got = queries.op8_pii(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(expected)
    texts = {r.doc_id: r.text or "" for r in source}
    for r in got:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert {f"{k}:{a}:{b}" for k, a, b in brute(texts[r.doc_id])} <= set(r.spans.split(","))
        assert [(int(a), pii.KINDS.index(k)) for k, a, _ in spans] == sorted((int(a), pii.KINDS.index(k)) for k, a, _ in spans)


@pytest.mark.parametrize(
    "text,redacted",
    [
        ("call (459) 555-9246 now", "call [PHONE] now"),
        ("+1 (459) 555-9246 452960346", "[PHONE] 452960346"),
        ("write to müller@firma.de.", "write to [EMAIL]."),
        ("4952935900253052 a.b@c.org 10.0.0.1", "[CARD] [EMAIL] [IP]"),
        ("on 2024-05-06 and 1234567890 or 4245100581169931", "on 2024-05-06 and 1234567890 or 4245100581169931"),
        ("978-3-1634-8410-0 1.234567 2020 2021 2022", "978-3-1634-8410-0 1.234567 2020 2021 2022"),
        ("@handle a@b x@", "@handle a@b x@"),
        ("", ""),
    ],
)
def test_redaction(text, redacted):
    assert pii.redact(text, pii.spans_of(text, pii.trained_field())) == redacted


def test_field_on_examples_it_has_not_seen():
    right = total = wrong = 0
    for text, before, spans in pii.made_up_examples(400, seed=99):
        found = pii.added_spans(f"{before} {text}", [], pii.trained_field())
        moved = {(k, a - len(before) - 1, b - len(before) - 1) for k, a, b in found}
        right, total, wrong = right + len(moved & set(spans)), total + len(spans), wrong + len(moved - set(spans))
    assert right >= 0.8 * total and wrong <= 0.05 * total


def all_segmentations(n, candidates, at=0):
    yield from ([[]] if at == n else [])
    if at < n:
        yield from all_segmentations(n, candidates, at + 1)
        for k, c in enumerate(candidates):
            if c.begin == at:
                for rest in all_segmentations(n, candidates, c.end):
                    yield [k, *rest]


def test_dynamic_programme_equals_all_segmentations():
    rnd = random.Random(3)
    for _ in range(40):
        n = rnd.randrange(1, 7)
        spans = {tuple(sorted(rnd.sample(range(n + 1), 2))) for _ in range(6)}
        candidates = [Candidate(a, b, k, (f"{k}{b - a}", f"{a % 2}{k}")) for a, b in sorted(spans) for k in "xy"]
        model = SemiMarkovField({f: rnd.gauss(0, 1) for c in candidates for f in c.features})
        every = list(all_segmentations(n, candidates))
        weight = [math.exp(sum(model.score(candidates[k]) for k in s)) for s in every]
        for k, p in enumerate(model.posteriors(n, candidates)):
            assert p == pytest.approx(sum(w for s, w in zip(every, weight) if k in s) / sum(weight))
        best = model.best(n, candidates)
        assert sum(model.score(candidates[k]) for k in best) == pytest.approx(math.log(max(weight)))


def test_fit_raises_the_likelihood():
    examples = [(2, [Candidate(0, 1, "x", ("a",)), Candidate(0, 2, "x", ("b",))], {1})]
    model = fit(examples)
    assert model.posteriors(2, examples[0][1])[1] > 0.8


def test_odd_and_empty_input(spark):
    odd = spark.createDataFrame(odd_rows(), DOCS).withColumns({c: F.lit("x") for c in ("spans", "redacted", "kind", "base")})
    assert pii.find_pii(odd).count() == len(odd_rows())
    assert pii.find_pii(spark.createDataFrame([], DOCS)).count() == 0
    assert pii.redacted_documents(odd).where("text is null").count() == 1


def test_long_texts_take_linear_time():
    start = time.process_time()
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "@" * 300_000, "a.b@" * 80_000):
        pii.spans_of(text, pii.trained_field())
    assert time.process_time() - start < 60
