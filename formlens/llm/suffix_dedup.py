"""Removal of byte strings that occur earlier, by a depth-limited radix sort of all suffixes.

Suffixes are ordered through their first ``length`` bytes only; those that stay equal start the same
string. There is a suffix per byte, so neighbours travel as one *bundle*: consecutive suffixes whose first
``length`` bytes share a *core*, the digit of a pass. Only bundles of equal cores can hold equal suffixes.
A pass counts the cores, drops bundles whose core occurs once, sorts the others by core and *extent*
(all that the bundle's strings cover together), and finds in one walk over the sorted rows

* equal extents: all but the earliest bundle are copies as a whole;
* cores with more than one extent: the earliest bundle of each is *open* and split for the next pass.

The first bundles are the strings that agree in their least hashed gram of 32 bytes and its place, some
35 suffixes each; the next ones are up to 17 neighbours; the last ones are single suffixes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlens.llm.common import bit_map, bit_words, bounded_batches, fresh_name, in_bit_map, may_hold, stored

LENGTH = 100
GRAM = 32
SLICE_BYTES = 1 << 20
HEAVY_SHARE = 2_000
HEAVY_ROWS = 1_000

MIX = np.uint64(0x9E3779B97F4A7C15)
STIR = np.uint64(0xC2B2AE3D27D4EB4F)
PLACE = ["last", "doc_id", "key", "start"]
BUNDLE = {"last": pa.bool_(), "doc_id": pa.int64(), "key": pa.int64(), "start": pa.int64(), "n": pa.int32(), "offset": pa.int32()}
BUNDLE_SCHEMA = "last boolean, doc_id long, key long, start long, n int, offset int"
SORTED = {"known": pa.bool_(), "core": pa.int64(), "extent": pa.int64()}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    return mixed(mixed(a * STIR) * MIX + b)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64 bits for every run of 32 bytes, by doubling from runs of 8."""
    if len(data) < GRAM:
        return np.empty(0, dtype=np.uint64)
    runs = mixed(np.lib.stride_tricks.sliding_window_view(data, 8).copy().view("<u8").ravel())
    for size in (8, 16):
        runs = joined(runs[:-size], runs[size:])
    return runs


def run_hashes(grams: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """64 bits for runs of 32 to ``2 * length - 32`` bytes: of the size and of grams that cover the run."""
    steps = 2 * (length - GRAM) // GRAM + 1
    runs, room = mixed(sizes.astype(np.uint64)), sizes - GRAM
    for step in range(steps + 1):
        runs = joined(runs, grams[starts + room * step // steps])
    return runs


def anchors(grams: np.ndarray, length: int) -> np.ndarray:
    """For every string of ``length`` bytes the place of its least gram, the first of equals."""
    width = length - GRAM + 1
    order = ((grams >> np.uint64(32)) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    padded = np.concatenate([order, np.full(-len(order) % width, np.iinfo(np.uint64).max)]).reshape(-1, width)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(grams) - width + 1
    return (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where its rows begin and the last one ends; null is empty."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype="<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", dtype=np.uint8), offsets


def first_bundles(batch: pa.RecordBatch, length: int) -> Iterator[dict[str, np.ndarray]]:
    """The bundles of texts ``(last, doc_id, key, text)`` by anchor, about a mebibyte of suffixes at a time.

    ``row`` is the text's place in the batch, ``offset`` the anchor's distance from the first suffix.
    """
    data, offsets = values(batch.column(3))
    for low in range(int(offsets[0]), int(offsets[-1]), SLICE_BYTES):
        high = min(low + SLICE_BYTES, int(offsets[-1]))
        part = data[low : min(high + length - 1, int(offsets[-1]))]
        if len(part) < length:
            continue
        grams = gram_hashes(part)
        anchor = anchors(grams, length)[: high - low]
        start = np.arange(low, low + len(anchor))
        row = np.searchsorted(offsets, start, side="right") - 1
        changes = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
        begins = np.flatnonzero(changes & (start + length <= offsets[row + 1]))
        row = row[begins]
        # A bundle ends where the next one begins, or with the last string that its text holds whole.
        n = np.minimum(np.append(begins[1:], len(anchor)), offsets[row + 1] - length + 1 - low) - begins
        offset = anchor[begins] - begins
        extent = joined(run_hashes(grams, begins, n + length - 1, length), offset.astype(np.uint64))
        # Least hashes are small numbers; the core must be spread over all of them.
        core = mixed(grams[anchor[begins]])
        yield {
            "row": row, "core": core.view(np.int64), "extent": extent.view(np.int64),
            "start": begins + low - offsets[row], "n": n, "offset": offset,
        }


def narrower_bundles(batch: pa.RecordBatch, length: int, width: int) -> Iterator[dict[str, np.ndarray]]:
    """Open bundles ``(last, doc_id, key, start, n, offset, span)`` cut to at most ``width`` suffixes.

    ``span`` is the bundle's extent in bytes. Cuts are at fixed distances from the anchor, so that equal
    suffixes meet; the core is what all suffixes between two cuts share, those of the bundle or not.
    """
    if not batch.num_rows:
        return
    data, offsets = values(batch.column(6))
    begin, n, offset = (batch.column(k).to_numpy().astype(np.int64) for k in (3, 4, 5))
    cuts = np.arange(0, length - GRAM + 1, width)
    row = np.repeat(np.arange(batch.num_rows), len(cuts))
    near = np.tile(cuts, batch.num_rows)
    far = np.minimum(near + width - 1, length - GRAM)
    low, high = np.maximum(near, offset[row] - n[row] + 1), np.minimum(far, offset[row])
    row, near, far, low, high = (x[low <= high] for x in (row, near, far, low, high))
    grams, anchor = gram_hashes(data), offsets[row] + offset[row]
    core = joined(run_hashes(grams, anchor - near, length - (far - near), length), near.astype(np.uint64))
    extent = joined(run_hashes(grams, anchor - high, high - low + length, length), ((high << 32) | low).astype(np.uint64))
    yield {
        "row": row, "core": core.view(np.int64), "extent": extent.view(np.int64),
        "start": begin[row] + offset[row] - high, "n": high - low + 1, "offset": high,
    }


def _repeated_cores(source: DataFrame, cut: Callable) -> DataFrame:
    """``(core, n)`` of the cores that occur more than once; batches are added up before rows leave Python."""

    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        cores, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(cores), pa.array(counts.astype(np.int64))], names=["core", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held += [bundles["core"] for bundles in cut(batch)]
            if sum(map(len, held)) > 1 << 20:
                yield summed(held)
                held = []
        if held:
            yield summed(held)

    counts = source.mapInArrow(count, "core long, n long").groupBy("core").agg(F.sum("n").alias("n"))
    return stored(counts.filter("n > 1"), "cores")


def _kept_bundles(source: DataFrame, cut: Callable, bits, heavy) -> DataFrame:
    """The bundles whose core may be repeated, with what they are dealt out by.

    Of equal extents in one batch all but the earliest are ``known`` copies and dealt out by place;
    bundles of heavy cores are dealt out by their extent, too.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundles in cut(batch):
                kept = np.flatnonzero(in_bit_map(bits.value, bundles["core"]))
                bundles = {name: column[kept] for name, column in bundles.items()}
                rows = bundles["row"]
                place = {name: batch.column(k).take(pa.array(rows)) for k, name in enumerate(PLACE[:3])}
                numbers = [place[name].cast(pa.int64()).fill_null(0).to_numpy() for name in PLACE[:3]] + [bundles["start"]]
                order = np.lexsort((*reversed(numbers), bundles["extent"], bundles["core"]))
                core, extent = bundles["core"][order], bundles["extent"][order]
                first = np.concatenate(([True], (core[1:] != core[:-1]) | (extent[1:] != extent[:-1])))[: len(core)]
                lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
                other = np.zeros(len(order), dtype=bool)
                for column in numbers:
                    other |= column[order] != column[order][lead]
                known = np.empty(len(order), dtype=bool)
                known[order] = other
                dealt = np.where(np.isin(bundles["core"], heavy.value), bundles["core"] ^ bundles["extent"], bundles["core"])
                dealt = np.where(known, numbers[2] ^ numbers[3], dealt)
                columns = {**bundles, **place, "known": known}
                arrays = [pa.array(columns[name], kind) if name not in place else place[name] for name, kind in {**SORTED, **BUNDLE}.items()]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(dealt)], names=[*SORTED, *BUNDLE, "dealt"])

    return source.mapInArrow(emit, f"known boolean, core long, extent long, {BUNDLE_SCHEMA}, dealt long")


def _walk(rows: DataFrame, heavy) -> DataFrame:
    """The copies and the open bundles among rows sorted by core, extent and place.

    From batch to batch only the last core's state goes on: its number of extents, the place of the
    last extent's earliest bundle, and the only open row, which waits for a second extent.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_core = last_extent = last_lead = waiting = None
        last_extents = 0
        for batch in batches:
            known = batch.column(0).to_numpy(zero_copy_only=False)
            sure = batch.filter(pa.array(known)).select(list(BUNDLE))
            yield sure.append_column("copied", pa.array(np.ones(len(sure), dtype=bool)))
            batch = batch.filter(pa.array(~known))
            if not batch.num_rows:
                continue
            core, extent = (batch.column(k).to_numpy() for k in (1, 2))
            place = np.stack([batch.column(k).cast(pa.int64()).fill_null(0).to_numpy() for k in (3, 4, 5, 6)], axis=1)
            goes_on = last_core is not None and core[0] == last_core
            begins = np.concatenate(([not goes_on or extent[0] != last_extent], (core[1:] != core[:-1]) | (extent[1:] != extent[:-1])))
            index = np.maximum.accumulate(np.where(begins, np.arange(len(core)), -1))
            lead = place[np.maximum(index, 0)]
            if index[0] < 0:
                lead[index < 0] = last_lead
            copied = ~begins & (place != lead).any(axis=1)
            group = np.cumsum(np.concatenate(([0], core[1:] != core[:-1])))
            extents = np.bincount(group, weights=begins).astype(np.int64)
            if goes_on:
                extents[0] += last_extents
            several = (extents > 1) | np.isin(core[np.flatnonzero(np.diff(group, prepend=-1))], heavy.value)
            if goes_on and several[0] and waiting is not None:
                yield waiting
                waiting = None
            kept = np.flatnonzero(copied | (begins & several[group]))
            found = batch.take(pa.array(kept)).select(list(BUNDLE))
            yield found.append_column("copied", pa.array(copied[kept]))
            if several[-1]:
                waiting = None
            elif len(extents) > 1 or not goes_on:
                only = batch.slice(int(np.flatnonzero(begins)[-1]), 1).select(list(BUNDLE))
                waiting = only.append_column("copied", pa.array([False]))
            last_core, last_extent, last_lead, last_extents = core[-1], extent[-1], lead[-1].copy(), extents[-1]

    dealt = rows.repartition("dealt").drop("dealt").sortWithinPartitions("known", "core", "extent", *PLACE)
    return dealt.mapInArrow(walk, f"{BUNDLE_SCHEMA}, copied boolean")


def radix_pass(source: DataFrame, cut: Callable) -> DataFrame:
    """One pass over the bundles that ``cut`` makes of a batch: the copies, and the open ones (not ``copied``).

    The map of repeated cores has 4 MiB at any size. Heavy cores are those with more than a
    2,000th of all repeated rows, so at most 2,000 numbers.
    """
    context = source.sparkSession.sparkContext
    counts = _repeated_cores(source, cut)
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.filter(F.col("n") > max(total // HEAVY_SHARE, HEAVY_ROWS)).select("core").toPandas()
    bits = context.broadcast(bit_words(bit_map(counts, "core")))
    heavy = context.broadcast(common["core"].to_numpy(dtype=np.int64))
    return stored(_walk(_kept_bundles(source, cut, bits, heavy), heavy), "pass")


def _spans_of(wide: DataFrame, opened: DataFrame, of: str, length: int) -> DataFrame:
    """The open bundles with their extents in bytes, cut from the column ``of`` of texts or wider spans."""
    named = opened.select(*(F.col(name).alias(f"open_{name}") for name in BUNDLE))
    same = F.col("doc_id").eqNullSafe(F.col("open_doc_id")) & (F.col("key") == F.col("open_key"))
    begin = F.lit(0)
    if of == "span":
        # An open bundle lies in one of those that it was cut from.
        begin = F.col("start")
        same &= (F.col("start") + F.col("offset") == F.col("open_start") + F.col("open_offset")) & (begin <= F.col("open_start"))
        same &= F.col("open_start") + F.col("open_n") <= F.col("start") + F.col("n")
    span = F.substring(of, (F.col("open_start") - begin + 1).cast("int"), F.col("open_n") + (length - 1))
    rows = wide.join(named.hint("shuffle_hash"), same)
    return rows.select(*(F.col(f"open_{name}").alias(name) for name in BUNDLE), span.alias("span"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, key, start, n)``: from byte ``start`` on, ``n`` strings of ``length`` bytes begin that occur earlier.

    ``key`` is the XXH64 of the text; documents without one and short ones have no row.
    """
    if length < GRAM:
        raise ValueError(f"strings need {GRAM} bytes or more")
    bounded_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    texts = docs.select(doc_id.isNull().alias("last"), doc_id.alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    texts = texts.filter(F.octet_length("text") >= length)

    found = radix_pass(texts, lambda batch: first_bundles(batch, length))
    copies, spans = [found.filter("copied")], None
    width = (length - GRAM) // 4
    while True:
        width = max(1, width)
        opened = found.filter("NOT copied").drop("copied")
        if spans is None:
            spans = _spans_of(may_hold(texts, "key", bit_map(opened, "key")), opened, "text", length)
        else:
            spans = _spans_of(spans, opened, "span", length)
        spans = stored(spans, "spans")
        found = radix_pass(spans, lambda batch, width=width: narrower_bundles(batch, length, width))
        copies.append(found.filter("copied"))
        if width == 1:
            return reduce(DataFrame.union, copies).select("doc_id", "key", "start", "n")
        width //= 16


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted disjoint runs that cover the same places; runs that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    begins = np.flatnonzero(np.concatenate(([True], starts[1:] > stops[:-1])))
    return starts[begins], stops[np.append(begins[1:], len(starts)) - 1]


def _spans(ranges: DataFrame, length: int) -> DataFrame:
    """``(doc_id, key, removed)``: the maximal runs of bytes to remove, by document."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            runs, offsets = batch.column(2), batch.column(2).offsets.to_numpy()
            starts, stops = (runs.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            out = []
            for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                begin, end = merged(starts[low:high], starts[low:high] + stops[low:high] + (length - 1))
                out.append([{"start": a, "stop": b} for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["doc_id", "key", "removed"])

    grouped = ranges.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return grouped.mapInArrow(merge, "doc_id long, key long, removed array<struct<start: long, stop: long>>")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with ``removed`` (runs of bytes, start and stop) and ``kept`` (the other bytes).

    A byte of the UTF-8 text is removed if it lies in a string of ``length`` bytes that also starts
    earlier: in a document with a smaller ``doc_id`` (null last, equal ones by a hash of the text),
    or further up in the same one. Strings are compared as the texts came in, and overlaps count.

    Null texts are empty; empty and short texts are kept whole. Rows equal in id and text are one
    document and fare alike. All columns pass through; if some are called ``removed`` or ``kept``,
    the new ones get underscores in front. Texts that have nothing to remove by the map of documents stay
    where they are; the others meet their runs in a join. An empty table stays empty.
    """
    spans = stored(_spans(repeated_ranges(docs, length), length), "removed")
    removed, kept = fresh_name(docs, "removed"), fresh_name(docs, "kept")
    key, of, of_key = (fresh_name(docs, f"suffix_dedup_{name}") for name in ("key", "id", "hash"))
    columns = [F.col(f"`{name}`") for name in docs.columns]
    keyed = docs.withColumn(key, F.xxhash64("text"))
    words = stored(bit_map(spans, "key"), "documents-to-cut")
    word, bits = fresh_name(keyed, "suffix_dedup_word"), fresh_name(keyed, "suffix_dedup_bits")
    marks = F.broadcast(words.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    marked = keyed.join(marks, F.shiftrightunsigned(key, 45) == F.col(word), "left")
    bit = F.expr(f"coalesce(shiftrightunsigned(`{bits}`, CAST(shiftrightunsigned(`{key}`, 39) & 63 AS INT)) & 1, 0)")
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    none = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    whole = marked.filter(bit == 0).select(*columns, none.alias(removed), data.alias(kept))
    spans = spans.select(F.col("doc_id").alias(of), F.col("key").alias(of_key), F.col("removed").alias(removed))
    cut = marked.filter(bit == 1).join(
        spans.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.col(key) == F.col(of_key)), "left"
    )
    runs = F.coalesce(F.col(removed), none)
    stops = F.concat(F.array(F.lit(0).cast("long")), F.transform(runs, lambda run: run["stop"]))
    starts = F.concat(F.transform(runs, lambda run: run["start"]), F.array(F.octet_length(data).cast("long")))
    # Bytes as strings of any bytes, which can be joined in one go.
    parts = F.zip_with(stops, starts, lambda a, b: F.substring(data, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    return whole.unionByName(cut.select(*columns, runs.alias(removed), F.array_join(parts, "").cast("binary").alias(kept)))
