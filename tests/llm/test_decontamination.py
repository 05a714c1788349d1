"""Decontamination against a plain search for every item in every text."""

from __future__ import annotations

import random
import re

import pytest
from helpers import DOCS, odd_rows
from pyspark.sql import functions as F

from perfmine.llm import decontamination as dc
from perfmine.llm import queries

ITEMS = "item_id long, text string"


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


def brute(docs, items):
    """(doc, item) whose five-word shingles are repeated by 75 % within a stretch of three item lengths."""
    found = set()
    for d, text in docs:
        words = plain_words(text or "")
        place = {}
        for i in range(len(words) - 4):
            place.setdefault(tuple(words[i : i + 5]), []).append(i)
        for item, t in items:
            own = plain_words(t)
            want = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
            if want and sum(s in place for s in want) >= 0.75 * len(want):
                found.add((d, item))
    return found


def pairs(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.op10_decontamination(spark, sf)
    assert pairs(got) == brute(docs, items)
    assert got.where("item_overlap < 0.75 and question_overlap < 0.75 or score < 0.5").count() == 0


def made(rnd, n):
    return [f"w{int(rnd.paretovariate(0.6))}" for _ in range(n)]


def test_planted_items_in_long_and_short_texts(spark, monkeypatch):
    rnd = random.Random(4)
    items = [(i, " ".join(made(rnd, rnd.randrange(12, 60)))) for i in range(300)] + [(900, " ".join(made(rnd, 700))), (901, "too few words")]
    docs = []
    for k in range(120):
        words = made(rnd, rnd.choice([5, 80, 900]))
        for i, t in rnd.sample(items, k % 3):
            at = rnd.randrange(len(words))
            own = t.upper().split()
            if k % 4 == 0 and len(own) > 30:
                own[rnd.randrange(len(own))] = "changed"
            words[at:at] = [f"{w}," for w in own]
        docs.append((k, " ".join(words)))
    got = pairs(dc.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)))
    expected = brute(docs, items)
    assert len(expected) > 60 and expected <= got
    # the question alone is enough, so more may be found, but only with the question in the text
    assert all(_question_in(dict(docs)[d], dict(items)[i]) for d, i in got - expected)
    monkeypatch.setattr(dc, "INDEX_CHARS", 5000)
    assert pairs(dc.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS))) >= expected


def _question_in(text, item):
    own = dc.make_item(0, item)
    return len(own.question & dc.shingles(dc.folded_words(text))) >= 0.75 * len(own.question)


def test_bounds_are_bounds_and_scores_those_of_bm25():
    rnd = random.Random(6)
    items = [dc.make_item(i, " ".join(made(rnd, 30))) for i in range(50)]
    index = dc.Index.build(items)
    words = made(rnd, 200) + items[7].words + made(rnd, 40)
    ids = {w: t for w, t in index.terms.items()}
    got = list(index.passages(words))
    expected = []
    for start in range(0, len(words), index.stride):
        own = {ids[w] for w in words[start : start + 2 * index.stride] if w in ids}
        for k in range(50):
            b, p = divmod(k, index.blocks[0].shape[1])
            score = sum(index.blocks[b][index.row[t, b], p] for t in own)
            if score >= dc.THRESHOLD:
                expected.append((k, start, round(score, 9)))
    assert {(k, s, round(x, 9)) for k, s, x in got} >= set(expected)
    assert any(k == 7 and x > 0.999 for k, _, x in got)


def asked(docs, items):
    """(doc, item) whose question is repeated by 75 % without regard to the answer."""
    found = set()
    for d, text in docs:
        have = dc.shingles(plain_bytes(text))
        for i, t in items:
            own = dc.make_item(i, t)
            if len(own.question) >= dc.LEAST_QUESTION and len(own.question & have) >= 0.75 * len(own.question):
                found.add((d, i))
    return found


def plain_bytes(text):
    return [w.encode() for w in plain_words(text)]


def test_question_without_its_answer(spark):
    rnd = random.Random(14)
    # common words ask, rare words answer; in others the rare words of a question stand together
    items = []
    for i in range(60):
        asking = [f"c{rnd.randrange(40)}" for _ in range(rnd.randrange(20, 50))]
        if i % 3 == 0:
            asking[-5:] = [f"r{i}x{k}" for k in range(5)]
        items.append((i, " ".join(asking) + "? " + " ".join(f"a{i}x{k}" for k in range(rnd.randrange(6, 25)))))
    docs = []
    for k in range(180):
        asking = items[k % 60][1].split("?")[0].split()
        lost = rnd.randrange(6) if k >= 60 else 0
        planted = asking[: len(asking) - lost]
        words = made(rnd, rnd.choice([5, 80, 900]))
        at = rnd.randrange(len(words))
        docs.append((k, " ".join(words[:at] + planted + words[at:])))
    got = pairs(dc.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)))
    expected = asked(docs, items)
    assert len(expected) > 120 and got == expected | brute(docs, items)


def test_every_question_of_eight_words_is_caught_word_for_word(spark):
    rnd = random.Random(16)
    items = [(n, " ".join(f"q{n}x{k}" for k in range(n)) + ". " + " ".join(f"a{n}x{k}" for k in range(10))) for n in range(6, 40)]
    docs = [(n, " ".join(made(rnd, 60) + t.split(". ")[0].split() + made(rnd, 60))) for n, t in items]
    rows = dc.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(n, n) for n in range(8, 40)}
    assert all(r.question_overlap == 1 and r.answer_overlap == 0 and r.item_overlap == (r.doc_id - 4) / (r.doc_id + 6) for r in rows)


def test_bars_allow_whatever_passes():
    rnd = random.Random(15)
    items = [dc.make_item(i, " ".join(made(rnd, rnd.randrange(12, 60))) + ". " + " ".join(made(rnd, rnd.randrange(5, 30)))) for i in range(40)]
    index = dc.Index.build(items)
    low = 0
    for part, owner in enumerate(index.owner):
        item = items[owner]
        words = item.words if part < len(items) else item.asking
        b, p = divmod(part, index.blocks[0].shape[1])
        all_of = [b" ".join(words[i : i + 5]) for i in range(len(words) - 4)]
        for _ in range(30):
            keep = [True] * len(all_of)
            while True:
                at, n = rnd.randrange(len(all_of)), rnd.randrange(1, 9)
                fewer = [x and not at <= i < at + n for i, x in enumerate(keep)]
                if len({s for s, x in zip(all_of, fewer) if x}) < 0.75 * len(set(all_of)):
                    break
                keep = fewer
            held = {w for s, x in zip(all_of, keep) if x for w in s.split()}
            score = sum(index.blocks[b][index.row[index.terms[w], b], p] for w in held)
            assert score >= index.bar[part]
            low += score < dc.THRESHOLD
    assert low > 0


def test_question_and_answer():
    item = dc.make_item(1, "What is the name of the city on the river? It is called by the old name here.")
    assert len(item.answer) == 4 and b"name of the city on" in item.question
    assert dc.make_item(2, "one two three four five six").answer == {b"two three four five six"}


def test_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS).withColumns({c: F.lit("x") for c in ("item_id", "score", "first_word")})
    items = spark.createDataFrame([(1, None), (2, ""), (3, "the the the and of"), (3, "the the the and of"), (None, "word word word word word word word")], ITEMS)
    got = pairs(dc.leaked_items(docs, items))
    assert {(15, 3), (13, None)} <= got
    assert dc.leaked_items(docs, spark.createDataFrame([], ITEMS)).count() == 0
    assert dc.leaked_items(spark.createDataFrame([], DOCS), items).count() == 0


def test_empty_index():
    assert dc.Index.build([]).leaks("any text at all") == []


def test_many_indexes_give_the_rows_of_one(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, dc.leaked_items(docs, items).collect()), key=repr)
    chars = items.selectExpr("sum(length(text))").first()[0]
    monkeypatch.setattr(dc, "INDEX_CHARS", int(chars * 2 / 3) + 1)
    assert len(dc.indexes_of(items)) == 3
    assert sorted(map(tuple, dc.leaked_items(docs, items).collect()), key=repr) == one and one
