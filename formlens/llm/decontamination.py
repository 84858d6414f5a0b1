"""Benchmark items in documents, up to a share of edits: random-walk embedding, bit sampling, exact check."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formlens.functions.process import per_process
from formlens.llm.common import bounded_batches, fresh_name, shipped, texts_of
from formlens.llm.vocabularies import Memory

MAX_EDITS = 0.2
RECALL = 0.9
LONG = 32
TABLES_PER_WALK = 8
MOST_WALKS = 64
BAND = 1.15
BAND_TRIALS = 512
BLOCK_BYTES = 8 << 20
CHUNK_WINDOWS = 32_768
CHUNK_CANDIDATES = 2_048
CHUNK_BYTES = 64 << 20
EXACT_STEP = 256
GAP, SPACE = 0, 32

_KEPT = {*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256), GAP}
# By first byte (0xE0, 0xE1) and second byte: whether the script has no spaces.
UNSPACED = np.zeros((2, 256), dtype=bool)
UNSPACED[0, 0xB8:] = True
UNSPACED[1, [0x80, 0x81, 0x82, 0x9E, 0x9F, *range(0xA5, 0xAB)]] = True
FOLD = bytes(code if code in _KEPT else SPACE for code in range(256))


def folded(text: str) -> bytes:
    """Lower case; runs of ASCII other than letters and digits are one space."""
    return re.sub(rb" +", b" ", text.lower().encode("utf-8", "surrogatepass").replace(b"\0", b" ").translate(FOLD))


def folded_batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts folded in one buffer, each followed by a gap; and where each one starts, and the end."""
    joined = "\0".join(text.replace("\0", " ") if "\0" in text else text for text in texts) + "\0"
    data = np.frombuffer(joined.lower().encode("utf-8", "surrogatepass").translate(FOLD), dtype=np.uint8)
    kept = np.ones(len(data), dtype=bool)
    kept[1:] = (data[1:] != SPACE) | (data[:-1] != SPACE)
    data = data[kept]
    return data, np.concatenate(([0], np.flatnonzero(data == GAP) + 1))


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where words begin; in scripts without spaces every character is one.

    These are first bytes of 0xE3 or more, 0xE0 before 0xB8 or more (Thai, Lao, Tibetan), and 0xE1 before
    0x80 to 0x82 (Burmese), 0x9E and 0x9F (Khmer) or 0xA5 to 0xAA (scripts of the Tai, Khmer signs).
    """
    inside = (data != SPACE) & (data != GAP)
    unspaced = data >= 0xE3
    at = np.flatnonzero((data[:-1] == 0xE0) | (data[:-1] == 0xE1))
    unspaced[at] = UNSPACED[data[at] - 0xE0, data[at + 1]]
    inside[1:] &= (data[:-1] == SPACE) | (data[:-1] == GAP) | unspaced[1:]
    return np.flatnonzero(inside)


def symbol_masks(item: bytes) -> np.ndarray:
    """For every byte value, in 64-bit words, the places of the item where it stands."""
    n_words = -(-len(item) // 64)
    bits = np.zeros((256, 64 * n_words), dtype=np.uint8)
    bits[np.frombuffer(item, dtype=np.uint8), np.arange(len(item))] = 1
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def least_edits(masks: np.ndarray, sizes: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """The edit distance of every item from the nearest part of its region, all side by side.

    ``masks`` has the items' ``symbol_masks`` (item, byte, word), all of as many words; ``regions`` a
    column per item, filled up with gaps at the end, which match nothing. Myers' bit vectors hold
    the differences down a column of the distance table; a part may begin and end anywhere.
    """
    n, _, n_words = masks.shape
    one = np.uint64(1)
    up = np.full((n_words, n), ~np.uint64(0))
    down = np.zeros((n_words, n), dtype=np.uint64)
    last = ((sizes - 1) % 64).astype(np.uint64)
    edits, best, across = sizes.astype(np.int64), sizes.astype(np.int64), np.arange(n)
    for symbols in regions:
        equal_words = masks[across, symbols]
        rise = fall = np.zeros(n, dtype=np.uint64)
        for word in range(n_words):
            equal, above, below = equal_words[:, word], up[word], down[word]
            vertical = equal | below
            equal = equal | fall
            diagonal = (((equal & above) + above) ^ above) | equal
            rises = below | ~(diagonal | above)
            falls = above & diagonal
            shift = last if word == n_words - 1 else np.uint64(63)
            next_rise, next_fall = (rises >> shift) & one, (falls >> shift) & one
            rises, falls = (rises << one) | rise, (falls << one) | fall
            up[word] = falls | ~(vertical | rises)
            down[word] = rises & vertical
            rise, fall = next_rise, next_fall
        edits += rise.astype(np.int64) - fall.astype(np.int64)
        np.minimum(best, edits, out=best)
    return best


@dataclass
class Walk:
    """One random-walk embedding with tables that each sample some of its steps."""

    bits: np.ndarray
    steps: list[np.ndarray]
    factors: list[np.ndarray]
    keys: list[np.ndarray] = field(default_factory=list)
    windows: list[np.ndarray] = field(default_factory=list)
    marks: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def drawn(cls, seed: int, n_steps: int, n_symbols: int) -> Walk:
        draw = np.random.default_rng(seed)
        bits = draw.integers(0, 2, (n_steps, 256), dtype=np.int64)
        steps = [np.sort(draw.choice(n_steps, min(n_symbols, n_steps), replace=False)) for _ in range(TABLES_PER_WALK)]
        factors = [draw.integers(1, 1 << 31, len(chosen), dtype=np.uint32) * np.uint32(2) + np.uint32(1) for chosen in steps]
        return cls(bits, steps, factors)

    def embed(self, data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """The table keys of the windows at ``starts``; ``data`` goes on for as many bytes as there are steps.

        A step writes the byte it stands on and moves on if the step's random bit for that byte is
        set, so two walks fall into step again after an edit. Nothing beyond the last sampled step
        is followed.
        """
        at, byte = starts.astype(np.int64), np.empty(len(starts), dtype=np.uint8)
        keys = [np.zeros(len(starts), dtype=np.uint32) for _ in self.steps]
        wanted: dict[int, list[tuple[int, np.uint32]]] = {}
        for table, (steps, factors) in enumerate(zip(self.steps, self.factors, strict=True)):
            for step, factor in zip(steps.tolist(), factors, strict=True):
                wanted.setdefault(step, []).append((table, factor))
        for step in range(max(wanted) + 1):
            np.take(data, at, out=byte, mode="clip")
            if step in wanted:
                symbol = byte.astype(np.uint32)
                for table, factor in wanted[step]:
                    # Mixed after each symbol, so that equal symbols at other places count differently.
                    keys[table] ^= symbol * factor
                    keys[table] *= np.uint32(0x9E3779B1)
            at += np.take(self.bits[step], byte)
        return keys

    def index(self, data: np.ndarray, starts: np.ndarray, owners: np.ndarray, mark_bits: int) -> None:
        for keys in self.embed(data, starts):
            order = np.argsort(keys, kind="stable")
            self.keys.append(keys[order])
            self.windows.append(owners[order])
            marks = np.zeros(1 << mark_bits, dtype=bool)
            marks[keys >> np.uint32(32 - mark_bits)] = True
            self.marks.append(marks)

    def matches(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a window (its place in ``starts``) and an item window that agree in some table."""
        shift = np.uint32(32 - int(len(self.marks[0])).bit_length() + 1)
        places, windows = [], []
        for table, keys in enumerate(self.embed(data, starts)):
            near = np.flatnonzero(self.marks[table][keys >> shift])
            low = np.searchsorted(self.keys[table], keys[near], side="left")
            sizes = np.searchsorted(self.keys[table], keys[near], side="right") - low
            near, low, sizes = near[sizes > 0], low[sizes > 0], sizes[sizes > 0]
            before = np.cumsum(sizes) - sizes
            places.append(np.repeat(near, sizes))
            windows.append(self.windows[table][np.repeat(low - before, sizes) + np.arange(sizes.sum())])
        return np.concatenate(places), np.concatenate(windows)


@dataclass
class ItemClass:
    """Items that are searched with one set of walks, and those that walks do not find: they meet whole texts."""

    cell: int
    walks: list[Walk]
    items: np.ndarray
    offsets: np.ndarray
    exact: list[int] = field(default_factory=list)


class ItemIndex:
    """A block of items, their windows in the tables, and the search of texts for them."""

    def __init__(self, ids: list[int], texts: list[str], max_edits: float, recall: float, seed: int = 7):
        pairs = sorted({(i, text) for i, text in zip(ids, map(folded, texts), strict=True) if text.strip()})
        self.ids = [i for i, _ in pairs]
        self.items = [text.strip() for _, text in pairs]
        self.most = [int(len(item) * max_edits) for item in self.items]
        self.classes: list[ItemClass] = []
        # At most half an item, so that windows within it begin at several of its words.
        sizes = np.array([min(LONG, max(1, (1 << len(item).bit_length()) // 4)) for item in self.items], dtype=np.int64)
        for size in np.unique(sizes).tolist():
            self._add_class(np.flatnonzero(sizes == size), size, max_edits, recall, seed)

    def _add_class(self, members: np.ndarray, size: int, max_edits: float, recall: float, seed: int) -> None:
        """Walks for items of ``size`` bytes or more: as many as find ``recall`` of edited samples in every band of lengths."""
        n_steps = max(1, 3 * size // 2)
        data, starts, owners, offsets = [], [], [], []
        at = 0
        for member in members.tolist():
            item = np.frombuffer(self.items[member], dtype=np.uint8)
            words = word_starts(item)
            words = words[(words <= max(0, len(item) - size))]
            starts.append(at + words)
            offsets.append(words)
            owners.append(np.full(len(words), member))
            data.append(np.concatenate((item, [GAP])))
            at += len(item) + 1
        data = np.concatenate((*data, np.zeros(n_steps))).astype(np.uint8)
        starts, owners, offsets = np.concatenate(starts), np.concatenate(owners), np.concatenate(offsets)
        found = ItemClass(size // 2 if size == LONG else 1, [], owners, offsets)
        self.classes.append(found)
        # Long items have more windows than short ones, so every narrow band of lengths has trials of its own;
        # of short items every length, as one byte more may allow one edit more.
        lengths = np.array([len(self.items[member]) for member in members.tolist()])
        bands = lengths if size < LONG else np.floor(np.log(lengths / lengths.min()) / np.log(BAND)).astype(np.int64)
        band_of = np.full(len(self.items), -1)
        band_of[members] = bands
        pending = np.unique(bands).tolist()
        trials = {band: self._edited(members[bands == band], max_edits, seed + band) for band in pending}
        missed = {band: list(range(len(trials[band]))) for band in pending}
        useful = 0
        while pending and len(found.walks) < MOST_WALKS:
            # Later walks hold the items of the bands that still need them.
            windows = np.flatnonzero(np.isin(band_of[owners], pending))
            # Unrelated windows of one language agree in up to one of four symbols that a table samples; with
            # so many symbols a window meets a wrong item window about once in 100,000 times.
            n_symbols = int(np.ceil(np.log(1e5 * len(windows)) / np.log(4.3)))
            mark_bits = int(np.clip(np.ceil(np.log2(64 * len(windows))), 10, 24))
            walk = Walk.drawn(seed * 100_000 + 1_000 * len(self.classes) + len(found.walks), n_steps, n_symbols)
            walk.index(data, starts[windows], windows, mark_bits)
            found.walks.append(walk)
            for band in list(pending):
                hits = self._hit([trials[band][trial][1] for trial in missed[band]], found, [walk])
                missed[band] = [trial for k, trial in enumerate(missed[band]) if (k, trials[band][trial][0]) not in hits]
                # Two standard errors above the target, as walks stop at the first number that passes.
                share = 1 - len(missed[band]) / len(trials[band])
                if share >= min(1.0, recall + 2 * (recall * (1 - recall) / len(trials[band])) ** 0.5):
                    pending.remove(band)
                    useful = len(found.walks)
        found.exact = members[np.isin(bands, pending)].tolist()
        del found.walks[useful:]

    def _edited(self, members: np.ndarray, max_edits: float, seed: int) -> list[tuple[int, bytes]]:
        """Sample items with as many random edits as allowed, at different distances into a text."""
        draw = np.random.default_rng(seed)
        trials = []
        letters = np.frombuffer(b"etaoinshrdlu ", dtype=np.uint8)
        for member in draw.choice(members, BAND_TRIALS, replace=True).tolist():
            text = list(self.items[member])
            for _ in range(self.most[member]):
                place, kind = int(draw.integers(0, max(1, len(text)))), int(draw.integers(0, 3))
                text[place : place + (kind != 0)] = [int(draw.choice(letters))] * (kind != 2)
            lead = b"x " * int(draw.integers(0, 16))
            trials.append((member, lead + bytes(text)))
        return trials

    def _hit(self, texts: list[bytes], found: ItemClass, walks: list[Walk]) -> set[tuple[int, int]]:
        data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
        bounds = np.concatenate(([0], np.flatnonzero(data == GAP) + 1))
        return set(self._search(data, bounds, found, walks))

    def _search(
        self, data: np.ndarray, bounds: np.ndarray, found: ItemClass, walks: list[Walk]
    ) -> Iterator[tuple[int, int]]:
        """``(text, item)`` for every text and every item of a class that it holds."""
        starts = word_starts(data)
        texts = np.searchsorted(bounds, starts, side="right") - 1
        # The first word start in every cell of a text: the choice depends on that text alone.
        cells = (starts - bounds[texts]) // found.cell
        first = np.ones(len(starts), dtype=bool)
        first[1:] = (cells[1:] != cells[:-1]) | (texts[1:] != texts[:-1])
        starts, texts = starts[first], texts[first]
        padded = np.concatenate((data, np.zeros(3 * LONG, dtype=np.uint8)))
        candidates: set[tuple[int, int, int]] = set()
        for low in range(0, len(starts), CHUNK_WINDOWS):
            part = starts[low : low + CHUNK_WINDOWS]
            base = int(part[0])
            near = padded[base : int(part[-1]) + 3 * LONG]
            for walk in walks:
                places, windows = walk.matches(near, part - base)
                begin = part[places] - found.offsets[windows]
                candidates.update(
                    zip(texts[low + places].tolist(), found.items[windows].tolist(), (begin // 16).tolist(), strict=True)
                )
        yield from self._verified(data, bounds, sorted(candidates))

    def _verified(
        self, data: np.ndarray, bounds: np.ndarray, candidates: list[tuple[int, int, int]]
    ) -> Iterator[tuple[int, int]]:
        """Text and item of the candidates (text, item, begin in sixteens) that are within the allowed edits."""
        masks = per_process("item masks", lambda: Memory(symbol_masks, 2_000))
        by_words: dict[int, list[tuple[int, int, int]]] = {}
        for candidate in candidates:
            by_words.setdefault(-(-len(self.items[candidate[1]]) // 64), []).append(candidate)
        for n_words, group in by_words.items():
            # Each candidate has a copy of its item's masks.
            n_part = min(CHUNK_CANDIDATES, max(1, CHUNK_BYTES // (2048 * n_words)))
            for low in range(0, len(group), n_part):
                part = group[low : low + n_part]
                texts, items, places = (np.array(column) for column in zip(*part, strict=True))
                sizes = np.array([len(self.items[item]) for item in items.tolist()])
                most = np.array([self.most[item] for item in items.tolist()])
                starts = np.maximum(bounds[texts], 16 * places - most - 16)
                stops = np.minimum(bounds[texts + 1] - 1, 16 * places + 32 + sizes + most)
                steps = np.arange(max(1, int((stops - starts).max())))[:, None]
                regions = np.where(starts + steps < stops, data[np.minimum(starts + steps, len(data) - 1)], GAP)
                own, place = np.unique(items, return_inverse=True)
                table = np.stack([masks[self.items[item]] for item in own.tolist()])[place]
                near = least_edits(table, sizes, regions) <= most
                yield from set(zip(texts[near].tolist(), items[near].tolist(), strict=True))

    def _whole(self, data: np.ndarray, bounds: np.ndarray, item: int) -> Iterator[tuple[int, int]]:
        """Text and item for every text that holds the item, by its edit distance from all parts of all texts."""
        size, most = len(self.items[item]), self.most[item]
        n_cells = -(-(bounds[1:] - 1 - bounds[:-1]) // EXACT_STEP)
        texts = np.repeat(np.arange(len(n_cells)), n_cells)
        starts = bounds[texts] + EXACT_STEP * (np.arange(len(texts)) - np.repeat(np.cumsum(n_cells) - n_cells, n_cells))
        stops = np.minimum(bounds[texts + 1] - 1, starts + EXACT_STEP + size + most)
        masks = symbol_masks(self.items[item])
        steps = np.arange(EXACT_STEP + size + most)[:, None]
        for low in range(0, len(texts), CHUNK_CANDIDATES):
            part, ends = starts[low : low + CHUNK_CANDIDATES], stops[low : low + CHUNK_CANDIDATES]
            regions = np.where(part + steps < ends, data[np.minimum(part + steps, len(data) - 1)], GAP)
            table = np.broadcast_to(masks, (len(part), *masks.shape))
            near = least_edits(table, np.full(len(part), size), regions) <= most
            yield from ((text, item) for text in set(texts[low : low + CHUNK_CANDIDATES][near].tolist()))

    def search(self, texts: list[str]) -> list[list[int]]:
        """For every text the ids of the items it holds, each once, in order."""
        data, bounds = folded_batch(texts)
        held: list[set[int]] = [set() for _ in texts]
        for found in self.classes:
            for text, item in self._search(data, bounds, found, found.walks):
                held[text].add(self.ids[item])
            for exact in found.exact:
                for text, item in self._whole(data, bounds, exact):
                    held[text].add(self.ids[item])
        return [sorted(ids) for ids in held]


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """The items in blocks of bounded size, chosen by hash."""
    items = items.selectExpr("CAST(item_id AS LONG) AS item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // block_bytes)
    for block in range(n_blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()
        if rows:
            yield [row.item_id for row in rows], [row.text for row in rows]


def find_items(
    docs: DataFrame,
    items: DataFrame,
    max_edits: float = MAX_EDITS,
    recall: float = RECALL,
    keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents with ``items_found``: ids of the benchmark items that they hold, sorted.

    An item ``(item_id, text)`` is held if some part of the text is at most ``max_edits`` times the
    item's length (rounded down, in bytes) away from it, both in lower case with everything but
    letters and digits folded to single spaces. Windows begin at a word in every cell of 16 bytes of a
    text (at every word if items are shorter than 64) and at every word of an item. They are seeds of 32 bytes
    (of a quarter to half the item if it is shorter than 64), not of an item's size: in a window as long as the
    item, a fifth of edits leaves no sampled table whole, while some of many short ones have few edits. A
    random-walk embedding turns edits into few differing places, and windows that agree in a table of sampled places are candidates, which
    are checked by exact edit distance. Walks with tables are added until ``recall`` of sample items,
    each with as many edits as allowed, are found in every narrow band of item lengths; items of bands
    that 64 walks do not bring there meet all parts of all texts. Unedited items whose words have up to 16 bytes are
    always found.

    Items are taken in blocks of ``block_bytes``, each scanning the documents once without a shuffle.
    Null and empty texts hold nothing; null items and items without letters or digits are held
    nowhere; repeated items are one. Without items nothing is found. Every row of ``docs`` gets its own
    result; ``keep`` names the columns to pass through (all by default). A column called
    ``items_found`` stays, and the new one gets underscores in front.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = docs.columns if keep is None else keep
    name = fresh_name(docs, "items_found")
    texts = "text" if "text" in keep else fresh_name(docs, "_decontamination_text")
    fields = [docs.schema[column] for column in keep]
    out = T.StructType([*fields, T.StructField(name, T.ArrayType(T.LongType()))])
    blocks = list(_index_blocks(items, block_bytes, max_edits, recall))
    if not blocks:
        return docs.select(*(f"`{column}`" for column in keep), F.array().cast("array<long>").alias(name))
    extra = [] if texts in keep else [F.col("text").alias(texts)]
    current = docs.select(*(f"`{column}`" for column in keep), *extra)
    for k, index in enumerate(blocks):
        shared = shipped(spark, index, f"items-{k}")
        last = k + 1 == len(blocks)
        carried = [] if last or not extra else [T.StructField(texts, T.StringType())]
        columns = [*keep, name, *(field.name for field in carried)]
        current = current.mapInArrow(_scanner(shared, name, texts, columns), T.StructType([*out.fields, *carried]))
    return current


def _index_blocks(items: DataFrame, block_bytes: int, max_edits: float, recall: float) -> Iterator[ItemIndex]:
    for ids, texts in _blocks(items, block_bytes):
        index = ItemIndex(ids, texts, max_edits, recall)
        if index.items:
            yield index


def _scanner(shared, name: str, texts: str, columns: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared()
        for batch in batches:
            found = index.search(texts_of(batch, texts))
            before = batch.column(name).to_pylist() if name in batch.schema.names else [[]] * batch.num_rows
            merged = [sorted({*old, *new}) for old, new in zip(before, found, strict=True)]
            arrays = [
                pa.array(merged, pa.list_(pa.int64())) if column == name else batch.column(column) for column in columns
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return scan
