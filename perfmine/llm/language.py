"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfmine.llm.common import arrow_map, id_and_text

BUCKETS = 1 << 14
MOST_LANGUAGES = 256
SMOOTHING = 0.5
#: A score weighs the evidence of at most so many n-grams, else every score would be 1.
EVIDENCE = 60
#: Characters whose n-grams are made at once, and cells (n-gram, language) scored at once.
SLICE, BATCH_CELLS = 250_000, 200_000
UNKNOWN = "und"
_PLANE = 0x3000
_LETTER = np.array([chr(c).isalpha() for c in range(_PLANE)])


def letters_and_blanks(text: str) -> np.ndarray:
    """The characters of a text: letters lower-cased, every run of others one blank."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype="<u4")
    letter = np.ones(len(code), dtype=bool)
    low = code < _PLANE
    letter[low] = _LETTER[code[low]]
    code = np.where(letter, code, np.uint32(32))
    return code[np.concatenate(([True], letter[1:] | letter[:-1]))]


def hashed_grams(code: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Buckets of the 1-, 2- and 3-grams that start at the first ``n`` characters; a blank alone is none."""
    code = code[: n + 2].astype(np.uint64)
    one = code * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + one[2:]
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    mixed = np.concatenate((one[:n][code[:n] != 32], two[:n], three[:n]))
    return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> shift).astype(np.int64)


def ngram_buckets(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket numbers of all 1-, 2- and 3-grams of the whole text.

    Letters are lower-cased; every run of other characters is one blank.
    """
    code = letters_and_blanks(text)
    return hashed_grams(code, len(code), buckets)


def gram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket has an n-gram of the whole text; slices bound the memory of long texts."""
    code = letters_and_blanks(text)
    total = np.zeros(buckets, dtype=np.int64)
    for at in range(0, len(code), SLICE):
        total += np.bincount(hashed_grams(code[at : at + SLICE + 2], SLICE, buckets), minlength=buckets)
    return total


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets x languages

    def predict(self, text: str) -> tuple[str, float]:
        return next(self.predict_all([text]))

    def predict_all(self, texts: Iterable[str]) -> Iterator[tuple[str, float]]:
        """(language, score) of each text; texts are scored in batches of sparse rows."""
        batch: list[tuple[np.ndarray, np.ndarray] | None] = []
        entries, most = 0, BATCH_CELLS // max(1, len(self.languages))
        for text in texts:
            row = None
            if self.languages and any(map(str.isalpha, text)):
                counts = gram_counts(text, len(self.log_prob))
                used = np.flatnonzero(counts)
                row = used, counts[used]
                entries += len(used)
            batch.append(row)
            if entries >= most or len(batch) >= 1000:
                yield from self._scored(batch)
                batch, entries = [], 0
        yield from self._scored(batch)

    def _scored(self, batch: list[tuple[np.ndarray, np.ndarray] | None]) -> Iterator[tuple[str, float]]:
        """Sparse rows (buckets, counts) times the matrix of log probabilities; None is a text without a letter."""
        rows = [r for r in batch if r is not None]
        answers = iter(())
        if rows:
            bucket, count = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
            first = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
            total = np.add.reduceat(self.log_prob[bucket] * count[:, None], first, axis=0)
            grams = np.add.reduceat(count, first)
            best = (total + self.log_prior).argmax(axis=1)
            weighed = total * np.minimum(1.0, EVIDENCE / grams)[:, None] + self.log_prior
            score = np.exp(weighed[np.arange(len(rows)), best] - np.logaddexp.reduce(weighed, axis=1))
            answers = zip([self.languages[k] for k in best], score.tolist(), strict=True)
        for r in batch:
            yield (UNKNOWN, 0.0) if r is None else next(answers)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> Model:
    """Fit on every row of ``docs`` that has a language.

    Each task adds up its own counts, Spark sums them by (language, bucket), and
    the driver gets at most ``MOST_LANGUAGES * buckets`` rows. An empty input
    gives a model without languages, which answers ``und``.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        totals: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in totals:
                    totals[lang], rows[lang] = np.zeros(buckets, dtype=np.int64), 0
                totals[lang] += gram_counts(text.as_py(), buckets)
                rows[lang] += 1
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield {
                "lang": [lang] * (len(used) + 1),
                "bucket": np.append(used, -1).astype(np.int32),
                "n": np.append(total[used], rows[lang]),
            }

    labelled = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    summed = arrow_map(labelled, counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = summed.toArrow()
    languages = sorted(set(got["lang"].to_pylist()))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return Model([], np.zeros(0), np.zeros((buckets, 0)))
    number = {lang: i for i, lang in enumerate(languages)}
    column = np.array([number[x] for x in got["lang"].to_pylist()])
    bucket, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    rows = np.zeros(len(languages))
    rows[column[bucket < 0]] = n[bucket < 0]
    table = np.zeros((buckets, len(languages)))
    table[bucket[bucket >= 0], column[bucket >= 0]] = n[bucket >= 0]
    log_prob = np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * buckets))
    return Model(languages, np.log(rows / rows.sum()), log_prob)


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its text alone.

    A text that is null or has no letter gives ``und`` with score 0. A tie goes
    to the first language by name. Rows that repeat get equal answers; a null id
    is kept. The broadcast matrix has at most ``MOST_LANGUAGES`` columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            answers = list(shared.value.predict_all(t.as_py() for t in batch.column(1)))
            yield {"doc_id": batch.column(0), "lang_pred": [a for a, _ in answers], "score": [s for _, s in answers]}

    return arrow_map(id_and_text(docs), work, "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, model: Model, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language the model recognises with at least that score.

    Only texts go through the model; the rows stay where they are. Null texts and
    texts without a letter are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        answers = shared.value.predict_all(t or "" for t in texts)
        return pd.Series([lang != UNKNOWN and score >= least_score for lang, score in answers], dtype=bool)

    return docs.where(known(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for the third of the documents that is kept out of training; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def trained_on_rest(docs: DataFrame) -> Model:
    """The model of the documents with an id that are not held out."""
    return train(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
