"""The pipeline, stage by stage, against plain Python."""

from __future__ import annotations

import corpus_pipeline as pipeline
import pandas as pd
import public_tokenizers
import pytest
from helpers import DOCS, odd_rows
from pyspark.sql import functions as F
from test_decontamination import brute as brute_leaks
from test_neardup import brute as brute_groups
from test_text_operators import check_packing

from perfmine.llm import language, pii
from perfmine.session import BATCH_BYTES, BATCH_KEY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Name -> rows, with those of the input as ``""``."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"": docs.collect()}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == list(pipeline.COLUMNS)
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_language_keeps_what_it_recognises(spark, stages):
    model = language.trained_on_rest(spark.read.parquet(f"{SF}/documents.parquet"))
    expected = [r for r in stages[""] if model.predict(r.text or "")[0] != "und" and model.predict(r.text or "")[1] >= pipeline.LEAST_SCORE]
    assert sorted(stages["language"]) == sorted(expected) and len(expected) > 0.95 * len(stages[""])


def test_one_of_each_group_stays(stages):
    groups = brute_groups([(r.doc_id, r.text) for r in stages["language"]])
    assert ids(stages["near_duplicates"]) == sorted(i for i, _, _, kept in groups if kept)
    assert set(stages["near_duplicates"]) <= set(stages["language"])


def test_contaminated_documents_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, _ in brute_leaks([(r.doc_id, r.text) for r in stages["near_duplicates"]], items)}
    assert bad
    assert sorted(stages["decontamination"]) == sorted(r for r in stages["near_duplicates"] if r.doc_id not in bad)


def test_personal_data_is_replaced(stages):
    model, changed = pii.trained_field(), 0
    before = {r.doc_id: r for r in stages["decontamination"]}
    assert ids(stages["personal_data"]) == sorted(before)
    for r in stages["personal_data"]:
        old = before[r.doc_id]
        text = pii.redact(old.text, pii.spans_of(old.text, model))
        assert (r.text, r.n_chars, r.lang, r.source) == (text, len(text), old.lang, old.source)
        changed += text != old.text
    assert changed


def test_packing_of_what_is_left(stages):
    assert check_packing([(r.doc_id, r.text) for r in stages["personal_data"]], stages["packing"], 4096) <= 1


def test_run_gives_the_last_stage(spark, stages):
    key = lambda rows: sorted((r.doc_id, r.ids_crc32) for r in rows if r.start == 0 and r.length == r.doc_tokens)
    got = pipeline.run(spark, SF).collect()
    assert sum(r.length for r in got) == sum(r.length for r in stages["packing"])
    assert len({r.doc_id for r in got}) == len(stages["personal_data"])
    assert set(key(got)) & set(key(stages["packing"]))


def test_stages_on_odd_and_empty_input(spark, tmp_path):
    spark.createDataFrame([(1, "no such passage anywhere in here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = spark.createDataFrame(odd_rows(), DOCS).withColumns({c: F.lit("x") for c in ("score", "kept", "spans", "id", "row")})
    for docs in (odd, odd.limit(0)):
        for name, stage in pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            rows = docs.collect()
            if name == "near_duplicates" and rows:
                own = [r.doc_id for r in rows]
                assert None in own and len(own) == len(set(own))


def test_only_copies_are_looked_up(spark):
    copy, other = " ".join(f"w{i}" for i in range(30)), "quite another text, all on its own here"
    rows = [(4, other, 1), (5, copy, 2), (3, copy, 3), (4, "a much " + other, 4), (5, copy, 5), (None, copy, 6), (8, "", 7), (3, copy, 8), (9, None, 9)]
    docs = spark.createDataFrame([(i, t, "en", "s", n) for i, t, n in rows], "doc_id int, text string, lang string, source string, n_chars int")
    got = pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(((r.doc_id, r.n_chars) for r in got.collect()), key=repr) == sorted([(3, 3), (4, 4), (8, 7), (9, 9), (None, 6)], key=repr)
    # the other texts take part in no join, so none of them is shuffled
    children = got._jdf.queryExecution().optimizedPlan().children()
    plans = [children.apply(i).toString() for i in range(children.size())]
    assert any("maybe" in p and "Join" not in p and "Aggregate" not in p for p in plans)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_texts_go_to_python_in_small_batches(spark, name):
    # ten texts of 0.4 MB in one partition, a batch of ten before
    docs = spark.range(10, numPartitions=1).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("mail a@b.example "), F.repeat(F.lit("word "), 80_000)).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(400_017).cast("long").alias("n_chars")
    )

    @F.pandas_udf("long")
    def in_batch(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    spark.conf.unset(BATCH_KEY)
    assert {r.n for r in docs.select(in_batch("text").alias("n")).collect()} == {4_000_170}
    made = dict(pipeline.STAGES)[name](spark, docs, SF)
    # a stage that replaces texts does so in the very batch that is measured
    of = made if name == "personal_data" else docs
    rows = of.select(F.length("text").alias("own"), in_batch("text").alias("n")).collect()
    assert len(rows) == 10 and all(r.own <= r.n <= 3 * BATCH_BYTES // 2 for r in rows)


def test_the_tokenizer_is_where_the_queries_say():
    from perfmine.llm.queries import tokenizer_path

    assert tokenizer_path("word_bpe_49k.json") == public_tokenizers.path("word_bpe_49k.json")
