"""Turns of conversations, put together in order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 64 << 20
BATCH_BYTES = 32 << 20
MESSAGE = pa.struct([("role", pa.string()), ("content", pa.string())])


def whole_conversations(turns: DataFrame, system: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(conv_id, messages)``: one row per conversation, its turns as role/content messages in order.

    Turns ``(conv_id, turn, role, text)`` are dealt out and sorted by Spark, which spills, and joined while
    they stream by: a task holds one conversation, and none is gathered in an aggregate. A conversation of
    more than ``max_bytes`` of text is an error that names it; nothing is cut. Nulls come first in ``turn``; equal ones
    follow by role and text. A null role is the user, a null text is empty; turns without a ``conv_id`` belong
    to no conversation and are left out. An optional ``system`` message opens every conversation.
    """
    turns.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    opening = [] if system is None else [{"role": "system", "content": system}]

    def rows(found: list[tuple[int, list]]) -> pa.RecordBatch:
        arrays = [pa.array([conv for conv, _ in found], pa.int64()), pa.array([messages for _, messages in found], pa.list_(MESSAGE))]
        return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "messages"])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, messages, size = None, [], 0
        for batch in batches:
            done: list[tuple[int, list]] = []
            for conv_id, role, text, n_bytes in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if conv_id != conv:
                    if conv is not None:
                        done.append((conv, messages))
                    conv, messages, size = conv_id, list(opening), 0
                size += n_bytes
                if size > max_bytes:
                    raise ValueError(f"conversation {conv} has over {max_bytes} bytes")
                messages.append({"role": role, "content": text})
            if done:
                yield rows(done)
        if conv is not None:
            yield rows([(conv, messages)])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ordered = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
        text.alias("text"),
        F.octet_length(text).alias("n_bytes"),
    )
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").drop("turn")
    return ordered.mapInArrow(put_together, "conv_id LONG, messages ARRAY<STRUCT<role: STRING, content: STRING>>")
