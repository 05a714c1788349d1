"""License scan, language, sharding, token counts and packing against plain Python."""

from __future__ import annotations

import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import DOCS, ODD_TEXTS, odd_rows, rows
from pyspark.sql import functions as F

from perfmine.llm import language, licenses, packing, queries, sharding, tokens
from perfmine.llm.pretokens import BYTE_PIECES, is_plain, loaded_tokenizer

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def sample(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").orderBy("doc_id").limit(300).collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    names = ("n_words", "score", "labels", "n_tokens", "slot", "ids", "task", "lang_pred", "spans", "kept", "component_id")
    return df.withColumns({n: F.lit("x") for n in names})


def test_token_counts_equal_the_library(spark, odd, sample):
    library = loaded_tokenizer(BYTES)
    docs = spark.createDataFrame(odd_rows() + [(100 + i, t, "en", "s", 1) for i, t in enumerate(sample)], DOCS)
    expected = sorted(
        (str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in (tuple(r) for r in docs.collect())
    )
    got = tokens.token_counts(clashing(docs), BYTES, cache=50).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == expected
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_pieces_equal_the_library(sample):
    library = loaded_tokenizer(BYTES)
    made = random.Random(3)
    alphabet = "ab'sLl  \n\t.,1²é<|"
    for text in [*sample[:50], *("".join(made.choice(alphabet) for _ in range(40)) for _ in range(2000))]:
        if is_plain(text):
            ends = [end for _, (_, end) in library.pre_tokenizer.pre_tokenize_str(text)]
            at, mine = 0, []
            for piece in BYTE_PIECES.findall(text):
                at += len(piece)
                mine.append(at)
            assert mine == ends, text


def check_packing(docs, got, window):
    library = loaded_tokenizer(WORDS)
    ids = {}
    for i, t in docs:
        run = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        ids[i] = np.array(run, dtype="<u4").tobytes()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i]) // 4
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[i][4 * r.start : 4 * at])
        assert 4 * at == len(ids[i])
    short = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        short += at < window
    return short


@pytest.mark.parametrize("window,open_windows,parts", [(4096, 16, 3), (64, 2, 7), (16, 1, 1)])
def test_packing_is_an_exact_round_trip(spark, sample, window, open_windows, parts):
    docs = [(i, t) for i, t in enumerate([*ODD_TEXTS, *sample])]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts))
    got = packing.pack(df, WORDS, window=window, open_windows=open_windows).collect()
    assert check_packing(docs, got, window) <= 1


def test_packing_merges_in_bundles(spark, sample):
    docs = list(enumerate(sample))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert check_packing(docs, packing.pack(df, WORDS, merged_tasks=2).collect(), 4096) <= 3


def test_packing_of_repeated_rows_null_ids_and_nothing(spark, odd, empty):
    got = packing.pack(odd, WORDS)
    totals = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert None in totals and totals[7] == 2 * got.where("doc_id = 7").first().doc_tokens
    assert packing.pack(empty, WORDS).count() == 0


def written(parsed):
    """All strings of a parsed regex, with one character of each class and one of each repetition without end."""
    out = [""]
    for op, value in parsed:
        op = str(op)
        if op == "LITERAL":
            more = [chr(value)]
        elif op == "IN":
            more = [next({"LITERAL": lambda v: chr(v), "RANGE": lambda v: chr(v[0]), "CATEGORY": lambda v: "x"}[str(k)](v) for k, v in value)]
        elif op == "BRANCH":
            more = [x for branch in value[1] for x in written(branch)]
        elif op == "SUBPATTERN":
            more = written(value[3])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = value
            more = ["".join(n * [x]) for x in written(inner) for n in {low, max(low, min(high, 1))}]
        else:
            raise NotImplementedError(op)
        out = [x + y for x in out for y in more]
    return out


def test_the_keyword_prefilter_hides_nothing():
    rules = [r for r in licenses.default_rules() if not r.name.startswith(("grant:", "tag:", "field:"))]
    filtered = licenses.Scanner(licenses.default_rules())
    every = licenses.Scanner(licenses.default_rules())
    every.automaton = type("All", (), {"iter": lambda self, flat: [(0, range(len(every.rules)))]})()
    for rule in rules:
        for text in set(written(re._parser.parse(rule.regex))):
            assert re.fullmatch(rule.regex, text) and any(k in text for k in rule.keyword.split(", ")), (rule.name, text)
    texts = ["do what the fuck you want to public license", "expat license", "psf license", "no reproduction", "unauthorized reproduction"]
    for text in texts + [f"licensed under the {t}" for t in texts] + ODD_TEXTS[1:13]:
        assert filtered.scan(text) == every.scan(text)
    labels = [[d[0] for d in filtered.scan(t)[1]] for t in texts]
    assert labels == [["wtfpl"], ["mit"], ["python-2.0"], ["no-redistribution"], ["no-redistribution"]]


def brute_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    found = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        want = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_license_base_equals_brute_force(spark, tmp_path):
    extra = ["CC-BY cc by cc_by.", "accc by", "GNU General Public License, version 3 or later", "all  rights\nRESERVED all rights reserved", "cc by ccé by é"]
    docs = spark.createDataFrame([*odd_rows(), *[(200 + i, t, "en", "s", 1) for i, t in enumerate(extra)]], DOCS)
    docs.union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000)).write.parquet(f"{tmp_path}/documents.parquet")
    source = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    got = queries.op1_license_scan(spark, str(tmp_path)).collect()
    mine = [(str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got]
    assert sorted(mine, key=str) == sorted(((str(r.doc_id), *brute_base(r.text)) for r in source), key=str)
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} for r in got)


@pytest.mark.parametrize(
    "text,labels",
    [
        ("Licensed under the Apache License, Version 2.0 (the License)", ["apache-2.0"]),
        ("SPDX-License-Identifier: GPL-3.0-or-later", ["gpl-3.0"]),
        ("Licensed under CC BY-NC 4.0.", ["cc-by", "cc-by-nc"]),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of", ["mit"]),
        ("the permit was an mit project", []),
        ("This is in the public domain", ["public-domain"]),
    ],
)
def test_license_rules(text, labels):
    _, found = licenses.Scanner(licenses.default_rules()).scan(text)
    assert sorted({d[0] for d in found}) == labels


def test_license_suppression():
    rule = lambda name, priority, base=False: licenses.Rule(name, name, name, name, priority, 0.5, base)
    strong, weak, base = rule("strong", 9), rule("weak", 5), rule("base", 1, True)
    found = [(weak, 2, 4), (strong, 1, 5), (weak, 4, 7), (base, 2, 3), (weak, 5, 6)]
    assert [(d[1], d[4], d[5]) for d in licenses.settled(found)] == [("strong", 1, 5), ("base", 2, 3), ("weak", 4, 7)]
    assert licenses.settled([(weak, 2, 4), (weak, 2, 4)]) == licenses.settled([(weak, 2, 4)])


def test_license_rules_are_many_and_gated():
    rules = licenses.default_rules()
    assert len(rules) > 200
    assert all(re.compile(r.regex) for r in rules)


def test_license_empty(empty):
    assert licenses.license_detections(empty).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    part = got.where("held_out")
    assert part.where("lang = lang_pred").count() >= 0.97 * part.count()
    assert got.where("score < 0 or score > 1").count() == 0
    assert got.where("held_out <> (crc32(cast(doc_id as string)) % 3 = 1)").count() == 0


def test_language_equals_plain_counts(spark):
    texts = [("en", "the cat and the dog"), ("de", "der hund und die katze"), ("en", "another thing"), ("de", "noch ein ding")]
    model = language.train(spark.createDataFrame(rows([t for _, t in texts]), DOCS).drop("lang").join(spark.createDataFrame([(i, x) for i, (x, _) in enumerate(texts)], "doc_id long, lang string"), "doc_id"))
    table = {x: np.zeros(language.BUCKETS) for x, _ in texts}
    for lang, text in texts:
        for b in language.ngram_buckets(text):
            table[lang][b] += 1
    for k, lang in enumerate(model.languages):
        expected = np.log((table[lang] + 0.5) / (table[lang].sum() + 0.5 * language.BUCKETS))
        assert np.allclose(expected, model.log_prob[:, k])
    assert model.predict("der hund")[0] == "de" and model.predict("123 %%")[0] == "und"


def test_ngrams_are_those_of_plain_python():
    text = "Ab1 c--é"
    plain = " ab c é "
    grams = [g for n in (1, 2, 3) for i in range(len(plain) - n + 1) if (g := plain[i : i + n]) != " "]
    assert len(language.ngram_buckets(text)) == len(grams)
    assert sorted(language.ngram_buckets(text)) == sorted(language.ngram_buckets("AB %% C é"))


def test_language_of_odd_and_empty_input(spark, odd, empty):
    got = {r.doc_id: r for r in language.predict_languages(clashing(odd), language.trained_on_rest(odd)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 3, 5))
    assert got[None].lang_pred == "en"
    assert language.predict_languages(empty, language.train(empty)).count() == 0
    assert language.predict_languages(odd, language.train(empty)).where("lang_pred <> 'und'").count() == 0


def brute_table(names, size):
    import hashlib

    order = sorted(range(len(names)), key=lambda i: names[i])
    preference = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "little") % size, int.from_bytes(d[8:16], "little") % (size - 1) + 1
        preference.append([(offset + skip * j) % size for j in range(size)])
    assert all(sorted(p) == list(range(size)) for p in preference)
    table = {}
    while len(table) < size:
        for s in order:
            if len(table) < size:
                table[next(x for x in preference[s] if x not in table)] = s
    return [table[i] for i in range(size)]


def test_sharding_table_by_brute_force():
    names = tuple("abcde")
    assert sharding.lookup_table(names, 101).tolist() == brute_table(names, 101)


def test_sharding_is_even_and_stable():
    table = sharding.lookup_table(sharding.SHARDS)
    share = np.bincount(table, minlength=64)
    assert share.max() - share.min() <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    kept = table != 63
    assert (table[kept] == fewer[kept]).mean() > 0.85
    mixed = sharding.SHARDS[::-1]
    assert [mixed[i] for i in sharding.lookup_table(mixed)] == [sharding.SHARDS[i] for i in table]
    weighted = np.bincount(sharding.lookup_table(("a", "b"), 1009, (1, 3)))
    assert 2.9 < weighted[1] / weighted[0] < 3.1
    for bad in ((("a", "a"), 101, None), (("a",), 100, None), ((), 101, None), (("a", "b"), 101, (1,))):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_sharding_places_every_row(spark, odd, empty, tmp_path):
    df = odd.withColumns({n: F.lit("x") for n in ("slot", "shard", "_row", "i")})
    placed = sharding.place(df, ["doc_id"])
    assert placed.count() == odd.count()
    assert placed.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    assert sharding.place(empty, ["doc_id"]).count() == 0
    sharding.write_shards(odd, ["doc_id"], f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == odd.count()


def test_license_spans_of_long_texts_take_linear_time():
    scanner = licenses.Scanner(licenses.default_rules())
    notice = "Licensed under the Apache License, Version 2.0. Ünï Released under CC BY-NC 4.0, all rights reserved. "
    one = scanner.scan(notice * 10)
    assert len(one[1]) == 10 * len(scanner.scan(notice * 2)[1]) / 2
    started = time.time()
    n, found = scanner.scan(notice * 30_000)
    assert time.time() - started < 60
    assert n == 3000 * one[0] and len(found) == 3000 * len(one[1])


def test_accepted_spans_equal_a_comparison_with_all():
    rnd = random.Random(3)
    rules = [r for r in licenses.default_rules() if not r.base][:40]
    for _ in range(200):
        found = []
        for _ in range(rnd.randint(0, 30)):
            start = rnd.randint(0, 20)
            found.append((rnd.choice(rules), start, start + rnd.randint(1, 8)))
        kept = []
        for rule, start, end in sorted(found, key=lambda d: (-d[0].priority, d[1] - d[2], d[1], d[0].name)):
            if not any(a <= start and end <= b for _, a, b in kept):
                kept.append((rule.name, start, end))
        assert sorted((d[1], d[4], d[5]) for d in licenses.settled(found)) == sorted(kept)


def test_language_answers_equal_a_plain_naive_bayes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows_ = docs.collect()
    counts, seen = {}, {}
    for r in rows_:
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(language.ngram_buckets(r.text or "").tolist())
            seen[r.lang] = seen.get(r.lang, 0) + 1
    sizes = {x: sum(c.values()) + 0.5 * language.BUCKETS for x, c in counts.items()}
    got = {r.doc_id: r for r in queries.op4_language_id(spark, "/root/testdata/sf0.001").collect()}
    for r in rows_:
        if not any(map(str.isalpha, r.text or "")):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        grams = Counter(language.ngram_buckets(r.text).tolist())
        prior = {x: math.log(n / sum(seen.values())) for x, n in seen.items()}
        like = {x: sum(n * math.log((counts[x][b] + 0.5) / sizes[x]) for b, n in grams.items()) for x in counts}
        best = max(sorted(counts), key=lambda x: like[x] + prior[x])
        part = min(1.0, language.EVIDENCE / sum(grams.values()))
        weights = {x: like[x] * part + prior[x] for x in counts}
        score = 1 / sum(math.exp(w - weights[best]) for w in weights.values())
        assert got[r.doc_id].lang_pred == best and abs(got[r.doc_id].score - score) < 1e-6


def test_language_of_a_very_long_text_takes_bounded_memory():
    names = [f"l{k:02}" for k in range(64)]
    rng = np.random.default_rng(0)
    table = np.log(rng.dirichlet(np.ones(language.BUCKETS), 64).T + 1e-9)
    model = language.Model(names, np.full(64, -math.log(64)), table)
    text = "Ein langer Text, der sich wiederholt; " * 80_000
    tracemalloc.start()
    (answer,) = model.predict_all([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and answer[0] in names
    assert (language.gram_counts(text) == np.bincount(language.ngram_buckets(text), minlength=language.BUCKETS)).all()
    together = list(model.predict_all(["kurz", "", text[:500_003], "noch ein Text"] * 3))
    assert together[4:8] == together[:4] and together[1] == ("und", 0.0)
