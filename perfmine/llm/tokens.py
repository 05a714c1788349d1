"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths of frequent pre-tokens, tier two a
cache in each worker that is filled by encoding the misses. Nothing is shuffled.
The frequent table comes from a bounded sample and only saves work: counts do
not depend on it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfmine.llm.common import arrow_map, id_and_text
from perfmine.llm.pretokens import BYTE_PIECES, PieceCache, is_plain, loaded_tokenizer

SAMPLE_ROWS = 500
SAMPLE_CHARS = 8_000
FREQUENT = 20_000
CACHE = 400_000


def frequent_lengths(docs: DataFrame, tokenizer: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, size: int = FREQUENT) -> dict[str, int]:
    """Lengths of the ``size`` most frequent pre-tokens of at most ``rows`` rows.

    The driver receives at most ``rows * chars`` characters.
    """
    sample = id_and_text(docs).select(F.substring("text", 1, chars).alias("text")).limit(rows).collect()
    tally: Counter[str] = Counter()
    for (text,) in sample:
        if is_plain(text):
            tally.update(BYTE_PIECES.findall(text))
    library = loaded_tokenizer(tokenizer)
    return {piece: len(library.encode(piece, add_special_tokens=False).ids) for piece, _ in tally.most_common(size)}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, cache: int = CACHE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    ``tokenizer`` is the path of a byte-level BPE file, the same on all machines.
    Counts are those of the library without added special tokens; special
    strings in a text count as the library takes them. A null or empty text has
    no tokens. Rows that repeat are counted each, a null id is kept. Texts are
    read whole, however long.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        library = loaded_tokenizer(tokenizer)

        def length(text: str) -> int:
            return len(library.encode(text, add_special_tokens=False).ids)

        lookup = PieceCache(length, frequent.value, cache).__getitem__
        for batch in batches:
            ids, texts = batch.columns
            counts = [
                sum(map(lookup, BYTE_PIECES.findall(t))) if is_plain(t) else length(t) for t in (x.as_py() for x in texts)
            ]
            yield {
                "doc_id": ids,
                "n_bytes": pc.binary_length(texts).cast(pa.int64()),
                "n_tokens": counts,
                "over_limit": [n > limit for n in counts],
            }

    return arrow_map(id_and_text(docs), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
