"""Packing of tokenised documents into windows of equal size by multiway differencing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from formlens.llm.common import bounded_batches, text_slices
from formlens.llm.differencing import fitting_windows
from formlens.llm.vocabularies import WORD_VOCABULARY, word_ids

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
FIELDS = pa.schema(
    [(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)


class _Windows:
    """Windows of one task. Whole windows are cut off long documents at once; the rest waits in ``tails``."""

    def __init__(self, task: int, capacity: int, piece: int, group: int, end_id: int):
        self.next_id, self.capacity, self.piece, self.group = task << 40, capacity, piece, group
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self.tails: list[tuple] = []
        self.out: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        ids += self.end
        n, size = len(ids) // 4, 4 * self.capacity
        whole = n // self.capacity
        for k in range(whole):
            crc = zlib.crc32(ids[k * size : (k + 1) * size])
            self.out.append((doc_id, k * self.capacity, self.capacity, crc, n, self.next_id, 0))
            self.next_id += 1
        if n % self.capacity:
            self.tails.append((doc_id, whole * self.capacity, n, ids[whole * size :]))
        if len(self.tails) >= 2 * self.group:
            self.pack(self.group)

    def pack(self, n_tails: int) -> None:
        """Cut the first tails into even pieces of bounded size and difference those into windows."""
        pieces = []
        for doc_id, start, n, ids in self.tails[:n_tails]:
            length = len(ids) // 4
            parts = -(-length // self.piece)
            edges = [length * part // parts for part in range(parts + 1)]
            for low, high in zip(edges, edges[1:], strict=False):
                pieces.append((doc_id, start + low, high - low, zlib.crc32(ids[4 * low : 4 * high]), n))
        del self.tails[:n_tails]
        if not pieces:
            return
        window, n_windows = fitting_windows(np.array([piece[2] for piece in pieces]), self.capacity)
        filled = [0] * n_windows
        for piece, slot in zip(pieces, window.tolist(), strict=True):
            self.out.append((*piece, self.next_id + slot, filled[slot]))
            filled[slot] += piece[2]
        self.next_id += n_windows

    def rows(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [[]] * len(FIELDS)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in columns], schema=FIELDS)


def pack_documents(
    docs: DataFrame, vocabulary: str = WORD_VOCABULARY, capacity: int = 2048, end_id: int = 1, piece: int = 512, group: int = 1024
) -> DataFrame:
    """Pieces of all documents ``(doc_id, text)``, placed in windows of at most ``capacity`` tokens.

    A document's ids are followed by ``end_id``. Whole windows are cut off documents longer than a
    window; every task then takes ``group`` remainders at a time (fewer than ``2 * group`` at its
    end), cuts them into even pieces of at most ``piece`` tokens and differences the pieces into
    near-equal windows. Nothing is shuffled; a task holds at most ``2 * group`` remainders.

    Null texts are empty: one piece with the end id. Null and repeated ids and repeated rows are
    packed like any other row. An empty table gives no pieces; other columns are ignored.
    Sequence ids number the windows of each task from ``task << 40``.
    """
    bounded_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(vocabulary).encode
        windows = _Windows(TaskContext.get().partitionId(), capacity, piece, group, end_id)
        for batch in batches:
            for part in text_slices(batch, 2000):
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                    windows.add(doc_id, ids)
                yield windows.rows()
        while windows.tails:
            windows.pack(2 * group)
        yield windows.rows()

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(pack, PIECES)
