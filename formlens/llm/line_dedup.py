"""Deletion of runs of lines that repeat earlier lines, found by winnowing over line hashes."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlens.llm.common import bounded_batches, fresh_name, stored, texts_of

MIN_WORDS = 50
HASH_BYTES = 16
LONG_RUN = 64
PRIME = (1 << 61) - 1
BASES = (1_000_000_007, 998_244_353)
ANCHORS = pa.list_(pa.struct([("fingerprint", pa.int64()), ("line", pa.int32())]))
RANGES = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())]))


def line_hashes(text: str) -> tuple[bytes, np.ndarray]:
    """16 bytes for every line, white space folded; and the lines' numbers of words."""
    hashes, words = [], []
    for line in text.split("\n"):
        parts = line.split()
        hashes.append(xxhash.xxh3_128_digest(" ".join(parts).encode("utf-8", "surrogatepass")))
        words.append(len(parts))
    return b"".join(hashes), np.array(words, dtype=np.int64)


def forward_windows(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """From every line, the shortest run of at least ``min_words`` words: starts and stops."""
    before = np.concatenate(([0], np.cumsum(words)))
    stops = np.searchsorted(before, before[:-1] + min_words, side="left")
    starts = np.flatnonzero(stops <= len(words))
    return starts, stops[starts]


def backward_windows(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to every line, the shortest run of at least ``min_words`` words: starts and stops."""
    before = np.concatenate(([0], np.cumsum(words)))
    stops = np.flatnonzero(before >= min_words)
    return np.searchsorted(before, before[stops] - min_words, side="right") - 1, stops


def window_minima(hashes: bytes, words: np.ndarray, min_words: int) -> list[int]:
    """The line of least weighted hash in every forward window.

    It depends on the window alone, so equal runs of ``min_words`` words have an equal line among
    these. Hashes are divided by the line's words, which favours long lines over common short ones.
    """
    order = (np.frombuffer(hashes, dtype="<u8")[::2] / np.maximum(words, 0.5)).tolist()
    chosen, waiting, upto = set(), deque(), 0
    # Windows move on at both ends: lines wait as long as no later one of the window is less.
    for start, stop in zip(*(ends.tolist() for ends in forward_windows(words, min_words)), strict=True):
        for line in range(upto, stop):
            while waiting and order[waiting[-1]] > order[line]:
                waiting.pop()
            waiting.append(line)
        upto = max(upto, stop)
        while waiting[0] < start:
            waiting.popleft()
        chosen.add(waiting[0])
    return sorted(chosen)


def run_hashes(hashes: bytes, runs: list[tuple[int, int]]) -> Iterator[bytes]:
    """A hash of 16 bytes for runs of lines (starts and stops) of a text with these line hashes.

    Runs of many lines, as with blank ones, are hashed from sums over the lines before, so that the time
    does not grow with their length.
    """
    sums = None
    for start, stop in runs:
        if stop - start <= LONG_RUN:
            yield xxhash.xxh3_128_digest(hashes[HASH_BYTES * start : HASH_BYTES * stop])
            continue
        if sums is None:
            sums = _prefix_sums(hashes)
        lanes = (
            (int(sums[k][stop]) - int(sums[k][start]) * pow(base, stop - start, PRIME)) % PRIME for k, base in enumerate(BASES)
        )
        yield xxhash.xxh3_128_digest(b"".join(lane.to_bytes(8, "little") for lane in (*lanes, stop - start)))


def _prefix_sums(hashes: bytes) -> list[np.ndarray]:
    lanes = np.frombuffer(hashes, dtype="<u8").reshape(-1, 2)
    sums = np.zeros((len(BASES), len(lanes) + 1), dtype=np.uint64)
    for k, base in enumerate(BASES):
        total = 0
        for line, value in enumerate(lanes[:, k].tolist(), 1):
            total = (total * base + value) % PRIME
            sums[k, line] = total
    return list(sums)


def kept_ranges(deleted: list[tuple[int, int]], n_lines: int) -> list[tuple[int, int]]:
    """Start and size of the runs of lines outside all of ``deleted`` (starts and stops)."""
    kept, at = [], 0
    for start, stop in sorted(deleted):
        if start > at:
            kept.append((at, start - at))
        at = max(at, stop)
    if n_lines > at:
        kept.append((at, n_lines - at))
    return kept


def _line_table(docs: DataFrame, min_words: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, counts, anchors = [], [], []
            for text in texts_of(batch):
                hashes, words = line_hashes(text)
                prints = np.frombuffer(hashes, dtype="<i8")[::2]
                lines = window_minima(hashes, words, min_words)
                blobs.append(hashes if lines else b"")
                counts.append(words.astype("<i4").tobytes() if lines else b"")
                anchors.append([{"fingerprint": prints[line], "line": line} for line in lines])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(blobs, pa.binary()),
                    pa.array(counts, pa.binary()),
                    pa.array(anchors, ANCHORS),
                ],
                names=["doc_id", "key", "hashes", "words", "anchors"],
            )

    schema = "doc_id long, key long, hashes binary, words binary, anchors array<struct<fingerprint: long, line: int>>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text").filter("text IS NOT NULL")
    return stored(texts.mapInArrow(read, schema).filter("size(anchors) > 0"), "lines")


def _windows(candidates: DataFrame, min_words: int) -> DataFrame:
    """The windows around repeated lines, to both sides: ``(doc_id, key, n_lines, window, start, stop)``."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, key, hashes, counts, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = np.frombuffer(counts, dtype="<i4").astype(np.int64)
                repeated = np.zeros(len(words) + 1, dtype=np.int64)
                repeated[np.array(lines) + 1] = 1
                repeated = np.cumsum(repeated)
                found = set()
                for starts, stops in (forward_windows(words, min_words), backward_windows(words, min_words)):
                    held = repeated[stops] > repeated[starts]
                    found.update(zip(starts[held].tolist(), stops[held].tolist(), strict=True))
                runs = sorted(found)
                for (start, stop), run in zip(runs, run_hashes(hashes, runs), strict=True):
                    out.append((doc_id, key, len(words), run, start, stop))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
            arrays = [pa.array(column, kind) for column, kind in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "n_lines", "window", "start", "stop"])

    schema = "doc_id long, key long, n_lines int, window binary, start int, stop int"
    return candidates.select("doc_id", "key", "hashes", "words", "lines").mapInArrow(extend, schema)


def _kept(deleted: DataFrame) -> DataFrame:
    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts = [], []
            for n_lines, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                ranges = kept_ranges([(run["start"], run["stop"]) for run in runs], n_lines)
                kept.append([{"start": start + 1, "size": size} for start, size in ranges])
                counts.append(n_lines - sum(size for _, size in ranges))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(kept, RANGES), pa.array(counts, pa.int32())],
                names=["doc_id", "key", "kept", "n_deleted"],
            )

    runs = deleted.groupBy("doc_id", "key").agg(
        F.first("n_lines").alias("n_lines"), F.collect_list(F.struct("start", "stop")).alias("runs")
    )
    return runs.mapInArrow(invert, "doc_id long, key long, kept array<struct<start: int, size: int>>, n_deleted int")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without repeated runs of lines, and ``n_lines`` and ``n_deleted`` (before, deleted).

    A line is deleted if it lies in a run of consecutive lines, of ``min_words`` words or more, that
    also occurs, line for line up to white space, earlier: in a document with a smaller ``doc_id``
    (null last, equal ones by a hash of the text), or further up in the same document.

    Of every shortest run of ``min_words`` words the line of least hash is a fingerprint; only
    fingerprints that occur twice are followed up. Around those, the runs to both sides are hashed,
    the first place of each is found by a combined minimum, and the later ones are deleted. No group
    of equal lines is ever gathered.

    Null texts stay null (no lines); the empty text is one line. A document that loses all its lines
    keeps an empty text. Rows equal in id and text count as one document and fare alike. Texts keep
    their other lines as they are, and all other columns pass through; if those are called
    ``n_lines`` or ``n_deleted``, the new ones get underscores in front. An empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    table = _line_table(docs, min_words)
    anchors = table.select("doc_id", "key", F.explode("anchors").alias("anchor"))
    anchors = anchors.select("doc_id", "key", "anchor.fingerprint", "anchor.line")
    # Stored, as are the first windows: a join of two shuffled scans is one that Spark can split at a common line.
    repeated = stored(anchors.groupBy("fingerprint").count().filter("count > 1").select("fingerprint"), "repeated-lines")
    lines = anchors.join(repeated, "fingerprint", "left_semi").groupBy("doc_id", "key")
    lines = lines.agg(F.collect_set("line").alias("lines"))
    lines = lines.select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), "lines")
    candidates = table.join(lines, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")))
    windows = stored(_windows(candidates, min_words).distinct(), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "start")
    first = windows.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = stored(first, "first-windows")
    later = windows.join(first.select("window", "first"), "window").filter(place != F.col("first"))
    kept = _kept(later)

    n_lines, n_deleted = fresh_name(docs, "n_lines"), fresh_name(docs, "n_deleted")
    key, ranges, gone, of, of_key = (fresh_name(docs, f"_line_dedup_{name}") for name in ("key", "kept", "gone", "id", "hash"))
    kept = kept.select(
        F.col("doc_id").alias(of), F.col("key").alias(of_key), F.col("kept").alias(ranges),
        F.col("n_deleted").alias(gone),
    )
    keyed = docs.withColumn(key, F.xxhash64("text"))
    same = keyed["doc_id"].cast("long").eqNullSafe(kept[of]) & (keyed[key] == kept[of_key])
    joined = keyed.join(kept.hint("shuffle_hash"), same, "left")
    parts = F.split("text", "\n", -1)
    # The outer lambda holds the split text, so that it is split once and not for every run.
    runs = F.transform(
        F.array(parts),
        lambda lines: F.flatten(F.transform(F.col(ranges), lambda run: F.slice(lines, run["start"], run["size"]))),
    )
    text = F.when(F.col(ranges).isNull(), F.col("text")).otherwise(F.array_join(runs[0], "\n"))
    return joined.select(
        *(text.alias(name) if name == "text" else F.col(f"`{name}`") for name in docs.columns),
        F.coalesce(F.size(parts), F.lit(0)).alias(n_lines),
        F.coalesce(F.col(gone), F.lit(0)).alias(n_deleted),
    )
