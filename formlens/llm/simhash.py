"""SimHash fingerprints and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlens.llm.common import bounded_batches, components, stored

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
BITS = 64
STRIDE = 16_384


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a UTF-8 text; zero without words.

    Lower-casing bytes changes A-Z alone, and bytes are split at the six ASCII white-space characters.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        stops = np.cumsum([len(word) + 1 for word in words])
        starts = [0, *stops[:-shingle_words].tolist()]
        digest = xxhash.xxh64_intdigest
        stops = (stops[shingle_words - 1 :] - 1).tolist()
        hashes = [digest(joined[start:stop], SEED) for start, stop in zip(starts, stops, strict=True)]
    ones = np.zeros(BITS, dtype=np.int64)
    values = np.array(hashes, dtype=">u8")
    for low in range(0, len(values), STRIDE):
        part = values[low : low + STRIDE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, print)``: the fingerprint of every document as a signed long."""
    bounded_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(text or b"", shingle_words) for text in batch.column(1).to_pylist()]
            prints = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], names=["doc_id", "print"])

    texts = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS BINARY) AS text")
    return texts.mapInArrow(each, "doc_id long, print long")


def segments(max_bits: int, n_segments: int) -> list[tuple[int, int, int]]:
    """First bit, width and radius of every segment.

    Two prints within ``max_bits`` differ in at most ``radius`` bits in one of the segments: were it
    more in each, the differences would add up to over ``max_bits``.
    """
    least, extra = divmod(max_bits, n_segments)
    edges = [BITS * k // n_segments for k in range(n_segments + 1)]
    # With a radius of one less beyond the first (extra + 1) segments the sum still exceeds max_bits.
    radii = [least if k <= extra else least - 1 for k in range(n_segments)]
    return [(a, b - a, radius) for a, b, radius in zip(edges, edges[1:], radii, strict=False) if radius >= 0]


def ball(value: Column, width: int, radius: int) -> Column:
    """All values of a segment that differ from ``value`` in up to ``radius`` bits."""
    masks = [0]
    reach = [0]
    for _ in range(radius):
        reach = sorted({mask | 1 << bit for mask in reach for bit in range(width) if not mask >> bit & 1})
        masks += reach
    return F.transform(F.array(*[F.lit(mask).cast("long") for mask in masks]), lambda mask: value.bitwiseXOR(mask))


def _segment(first: int, width: int) -> Column:
    mask = (1 << width) - 1
    return F.shiftrightunsigned("print", BITS - first - width).bitwiseAND(F.lit(mask).cast("long"))


def print_links(prints: DataFrame, max_bits: int = MAX_BITS, n_segments: int = 2) -> DataFrame:
    """``(a, b)``: all pairs of distinct fingerprints ``(print)`` with at most ``max_bits`` different bits.

    Every fingerprint stands in one table per segment, under the segment's value. Each one asks the
    tables for all values in the ball around its own segment, and a match is kept if the whole
    distance is small enough. The check is part of the join, so no unverified pair leaves it, and a
    crowded segment value is a skewed join that Spark splits.
    """
    parts = segments(max_bits, n_segments)
    table = prints.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("segment"), _segment(first, width).alias("value"))
                            for k, (first, width, _) in enumerate(parts)])).alias("key"),
        F.col("print").alias("b"),
    ).select("key.segment", "key.value", "b")
    asked = None
    for k, (first, width, radius) in enumerate(parts):
        one = prints.select(F.lit(k).alias("segment"), F.explode(ball(_segment(first, width), width, radius)).alias("value"),
                            F.col("print").alias("a"))
        asked = one if asked is None else asked.union(one)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    joined = asked.join(table, (asked["segment"] == table["segment"]) & (asked["value"] == table["value"])
                        & (F.col("a") < F.col("b")) & near)
    return joined.select("a", "b")


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, n_segments: int = 2
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every document.

    The fingerprint is the 64-bit SimHash of the text's word shingles, in hexadecimal; documents link
    at ``max_bits`` or fewer different bits, and a component is named by its smallest ``doc_id``.
    Equal fingerprints are one node, so copies never meet in pairs.

    Null and empty texts, and texts of white space, have fingerprint zero and link like any other.
    Null ids stay null and join their group's component, which is named by its smallest non-null id
    (null if there is none). Repeated rows each get a row. An empty table gives no rows; other
    columns are ignored.
    """
    table = stored(fingerprints(docs, shingle_words), "fingerprints")
    nodes = table.groupBy("print").agg(F.min("doc_id").alias("first"))
    links = print_links(nodes.select("print"), max_bits, n_segments)
    groups = components(links)
    named = nodes.join(groups, nodes["print"] == groups["node"], "left")
    group = F.coalesce("component", "print")
    named = stored(named.select("print", "first", group.alias("group")), "print-groups")
    names = stored(named.groupBy("group").agg(F.min("first").alias("component_id")), "group-names")
    of_print = stored(named.join(names, "group").select("print", "component_id"), "print-components")
    return table.join(of_print, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
