"""What several operators share: stored tables, batches of texts, and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens.functions.process import latest_of_process
from formlens.sources.tables import stored

__all__ = [
    "bit_map", "bit_words", "bounded_batches", "components", "fresh_name", "in_bit_map", "may_hold", "sampled", "shipped", "stored",
    "text_slices", "texts_of",
]

BATCH_BYTES = 4 << 20
MAP_BITS = 25


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches hold a bounded number of bytes, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def sampled(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """About ``n`` of the rows (all of fewer), chosen by a hash of the columns ``by``."""
    parts = 1 << 30
    share = min(parts, parts * n // max(1, rows.count()))
    return rows.filter(F.pmod(F.xxhash64(*by), F.lit(parts)) < share)


def shipped(spark: SparkSession, value: Any, slot: str) -> Callable[[], Any]:
    """A function that has ``value`` in tasks, loaded once per process; ``slot`` keeps the latest of a kind.

    A broadcast object is looked up by its class's name. Here the class travels with it, so that workers need
    not have this package.
    """
    blob, token = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex
    return lambda: latest_of_process(slot, token, lambda: cloudpickle.loads(blob.value))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [text or "" for text in batch.column(name).to_pylist()]


def text_slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def fresh_name(frame: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of the frame is called that."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _checksum(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges`` ``(a, b)``; a component is named by its smallest node.

    Alternates large-star and small-star steps until the edges are stars. A step needs the
    smallest neighbour of each node (combined in the map tasks) and one join by node. Both are
    stored tables: a join of two shuffled scans is one that Spark can split at a hub.
    """
    edges = edges.select("a", "b").filter("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()
    edges = stored(edges, "links")
    before = _checksum(edges)
    while before[0]:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large.filter("a <> b"), "links")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        after = _checksum(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def bit_map(keys: DataFrame, name: str) -> DataFrame:
    """``(word, bits)``: a bit per key, by the first 25 bits of the hash ``name``; at most 2^19 rows, 4 MiB of bits.

    Keys share bits, so a set bit says that a key *may* be among them; what it lets pass must be
    told apart by an exact step. The size does not grow with the keys.
    """
    slot = F.shiftrightunsigned(name, 64 - MAP_BITS)
    bit = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(`{name}`, {64 - MAP_BITS}) & 63 AS INT))")
    return keys.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def may_hold(frame: DataFrame, name: str, words: DataFrame) -> DataFrame:
    """The rows of ``frame`` whose hash ``name`` has its bit set; the map's bounded size is broadcast."""
    word, bits = fresh_name(frame, "word"), fresh_name(frame, "bits")
    words = words.select(F.col("word").alias(word), F.col("bits").alias(bits))
    keyed = frame.join(F.broadcast(words), F.shiftrightunsigned(name, 70 - MAP_BITS) == F.col(word))
    bit = F.expr(f"shiftrightunsigned(`{bits}`, CAST(shiftrightunsigned(`{name}`, {64 - MAP_BITS}) & 63 AS INT)) & 1")
    return keyed.filter(bit == 1).drop(word, bits)


def bit_words(words: DataFrame) -> np.ndarray:
    """The map as an array for Python tasks."""
    rows = words.toPandas()
    bits = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
    bits[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return bits


def in_bit_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    return ((bits[slot >> 6] >> (slot & 63)) & 1).astype(bool)
