"""From raw documents to packed training sequences.

Each stage gets what its predecessor kept. All stages but the last return the
columns of ``documents``. Each bounds the batches of texts that go to Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfmine.llm import decontamination, language, neardup, packing, pii
from perfmine.llm.common import bounded_batches, staged, table
from perfmine.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose best language scores less is rejected.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language.

    The classifier learns from the labelled documents of its input that are not
    held out. A document goes if its text is null or has no letter, or if no
    language reaches ``LEAST_SCORE``. Where nothing is labelled there is nothing
    to recognise, and all documents go.
    """
    bounded_batches(spark)
    return language.recognised(docs.select(*COLUMNS), language.trained_on_rest(docs), LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one with the smallest id.

    Rows that repeat an id are one document, of which the row with the least text
    stays. A row without an id is no copy of any other and stays.
    """
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    verdicts = neardup.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    # few documents go and few ids repeat: only the texts of these are looked up, the others stay where they are
    marked = staged(verdicts.where("n > 1 or not kept").select(F.col("doc_id").alias("id"), "kept"), "marked-ids")
    repeated = marked.where("kept")
    maybe_marked, maybe_repeated = neardup.maybe_among(marked), neardup.maybe_among(repeated)
    own = F.col("doc_id").cast("long")
    alone = docs.where(own.isNull() | ~maybe_marked(own))
    once = docs.where(own.isNotNull() & maybe_marked(own)).join(marked, F.col("doc_id") == F.col("id"), "left_anti")
    rest = [c for c in COLUMNS if c != "doc_id"]
    again = docs.where(own.isNotNull() & maybe_repeated(own)).join(repeated, F.col("doc_id") == F.col("id"), "left_semi")
    again = again.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "row.*")
    return alone.unionByName(once).unionByName(again)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that repeat an item of the benchmark."""
    bounded_batches(spark)
    return decontamination.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep all documents, with personal data replaced by its kind."""
    bounded_batches(spark)
    return pii.redacted_documents(docs.select(*COLUMNS))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 ids."""
    bounded_batches(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", redact_personal_data),
    ("packing", pack_windows),
]

#: SQL has neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
