"""Bounded-space online packing of token ids into fixed windows.

Each partition keeps a fixed number of open windows. A document goes, whole, to
the open window that it fills best. When none has room and no further window may
be opened, the fullest one is filled up with the document's first ids and
emitted, and the rest of the document goes on. What is left open at the end of a
partition is merged with the leftovers of its neighbours.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfmine.llm.common import arrow_map, id_and_text, staged
from perfmine.llm.pretokens import WORD_PIECES, PieceCache, byte_chars, is_plain, loaded_tokenizer, worker_cache

WINDOW = 4096
OPEN_WINDOWS = 16
MERGED_TASKS = 64
END_ID = 2
CACHE = 250_000
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PLACED = f"{_PIECE}, task long, ids binary"


@dataclass
class Window:
    pieces: list[tuple] = field(default_factory=list)  # doc_id, start, ids, doc_tokens
    fill: int = 0

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        self.pieces.append((doc_id, start, ids, doc_tokens))
        self.fill += len(ids) // 4


class Packer:
    """Places runs of ids (little-endian, 4 bytes each) into windows of ``size`` ids."""

    def __init__(self, size: int, open_windows: int):
        self.size, self.most, self.open = size, open_windows, []

    def place(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> Iterator[Window]:
        """Put one run somewhere; yields the windows that this fills."""
        while ids:
            n = len(ids) // 4
            target = None
            if n < self.size:
                fits = [w for w in self.open if self.size - w.fill >= n]
                if fits:
                    target = max(fits, key=lambda w: w.fill)
                elif len(self.open) >= self.most:
                    target = max(self.open, key=lambda w: w.fill)
            if target is None:
                target = Window()
                self.open.append(target)
            room = self.size - target.fill
            target.add(doc_id, start, ids[: 4 * room], doc_tokens)
            ids, start = ids[4 * room :], start + room
            if target.fill == self.size:
                self.open.remove(target)
                yield target

    def flush(self) -> Iterator[Window]:
        """Fill the fullest windows from the emptiest ones; only the last may stay short."""
        left = sorted(self.open, key=lambda w: w.fill)
        self.open = []
        while len(left) > 1:
            into, source = left.pop(), left.pop(0)
            for k, (doc_id, start, ids, doc_tokens) in enumerate(source.pieces):
                room = self.size - into.fill
                into.add(doc_id, start, ids[: 4 * room], doc_tokens)
                if into.fill == self.size:
                    rest = Window()
                    if ids[4 * room :]:
                        rest.add(doc_id, start + room, ids[4 * room :], doc_tokens)
                    for piece in source.pieces[k + 1 :]:
                        rest.add(*piece)
                    yield into
                    left = sorted([*left, rest] if rest.fill else left, key=lambda w: w.fill)
                    break
            else:
                left = sorted([*left, into], key=lambda w: w.fill)
        yield from left


def token_ids(tokenizer: str, cache: int = CACHE):
    """A function text -> ids as bytes, of whole texts.

    No piece of the word tokenizer reaches over white space, so plain text is
    looked up by what stands between it; what is not known yet is put together
    from its pieces, and new pieces go to the library's merges alone. A worker
    keeps both caches.
    """
    library = loaded_tokenizer(tokenizer)
    model = library.model

    def encode(text: str) -> bytes:
        return np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def merged(piece: str) -> bytes:
        ids = [t.id for t in model.tokenize(byte_chars(piece))]
        return struct.pack(f"<{len(ids)}I", *ids)

    pieces = worker_cache((tokenizer, "pieces"), lambda: PieceCache(merged, {}, cache)).__getitem__

    def put_together(chunk: str) -> bytes:
        return b"".join(map(pieces, WORD_PIECES.findall(chunk)))

    lookup = worker_cache((tokenizer, "chunks"), lambda: PieceCache(put_together, {}, cache)).__getitem__

    def ids(text: str) -> bytes:
        return b"".join(map(lookup, text.lower().split())) if is_plain(text) else encode(text)

    return ids


def _rows(window: Window, sequence: int) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, ids, doc_tokens in window.pieces:
        n = len(ids) // 4
        yield doc_id, start, n, zlib.crc32(ids), doc_tokens, sequence, offset
        offset += n


def _columns(rows: list[tuple], names: str) -> dict:
    keys = [x.split()[0] for x in names.split(", ")]
    return dict(zip(keys, map(list, zip(*rows, strict=True)), strict=True)) if rows else {k: [] for k in keys}


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID, merged_tasks: int = MERGED_TASKS) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document's ids are those of the library without special tokens, then
    ``end_id``; so an empty or null text is one id long. Every id lies in exactly
    one piece. All sequences are full but one per ``merged_tasks`` partitions.
    Repeated rows and rows with a null id are packed like any other. An empty
    input gives no rows.

    A task holds ``open_windows`` windows; the merge of leftovers holds those of
    ``merged_tasks`` tasks. Packed pieces are written as a table in the shared
    folder before leftovers are merged, so no text is encoded twice.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode_and_pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        task = TaskContext.get().partitionId()
        ids_of, packer, sequence = token_ids(tokenizer), Packer(window, open_windows), task << 36
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py()) + end
                for full in packer.place(doc_id, 0, ids, len(ids) // 4):
                    rows += [(*r, task, None) for r in _rows(full, sequence)]
                    sequence += 1
            yield _columns(rows, _PLACED)
        left = [(d, s, len(i) // 4, 0, n, None, None, task, i) for w in packer.open for d, s, i, n in w.pieces]
        yield _columns(left, _PLACED)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        packer, group, sequence = Packer(window, open_windows), None, 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["bundle"] != group:
                    for short in packer.flush():
                        rows += _rows(short, sequence)
                        sequence += 1
                    group, sequence = r["bundle"], (1 << 62) + (r["bundle"] << 32)
                for full in packer.place(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]):
                    rows += _rows(full, sequence)
                    sequence += 1
            yield _columns(rows, _PIECE)
        rows = []
        for short in packer.flush():
            rows += _rows(short, sequence)
            sequence += 1
        yield _columns(rows, _PIECE)

    placed = staged(arrow_map(id_and_text(docs), encode_and_pack, _PLACED), "packed")
    names = [x.split()[0] for x in _PIECE.split(", ")]
    leftovers = (
        placed.where(F.col("sequence_id").isNull())
        .select("doc_id", "start", "doc_tokens", "ids", F.floor(F.col("task") / merged_tasks).cast("long").alias("bundle"))
        .repartition("bundle")
        .sortWithinPartitions("bundle", "doc_id", "start")
    )
    merged = arrow_map(leftovers, merge, _PIECE)
    return placed.where(F.col("sequence_id").isNotNull()).select(*names).unionByName(merged.select(*names))
