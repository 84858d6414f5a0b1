"""Frequent phrases whose words belong together, from a weighted de Bruijn graph of words.

Edges are phrases of four words, each from the node of its first three to that of its last three, with the
number of times they occur. Only edges are counted; how often a shorter phrase occurs is the flow
through it: a node's outgoing edges and the pieces that end with it, a pair's nodes that end with it and
the pieces that begin with it, a word's nodes that begin with it and the pieces whose last two words
have it. Frequent edges are compacted: chains of nodes with one way in and one way out become
paths, and a path spells its words and counts once for all phrases in it.

Words are 64-bit hashes of language and word until the end: an edge is ``(w1, w23, w4)`` with one
hash for the middle pair, a node ``(w1, w23)``; 0 stands for no word. A pair's hash is a hash of its first
word xor its second word, so the first word tells the second: a pair takes the first half of its first word's
hash along, in the unused half of its count and once in what a task hands on together. Only words are
looked up in the texts. Words that share this half are all tried; just one leaves a word as the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlens.llm.common import bit_map, bit_words, bounded_batches, in_bit_map, sampled, stored

MIN_COUNT = 30
TOP = 2_000
CONTAINED = 80
SCALE = 2_000_000
UNKNOWN = "und"

SEGMENT_BYTES = 1 << 20
HELD_GRAMS = 1 << 21
SLOT_BITS = 22
HELD_WORDS = 200_000
HELD_LANGUAGES = 8
HELD_WORD_BYTES = 64
TOLD_WORDS = 1 << 17
SAMPLED_DOCS = 20_000
HEAVY_SHARE = 2_000
PATH_CUT = 64
PATH_ROUNDS = 12
BUCKETS = 256

# Bytes that end a piece become one that no UTF-8 text has.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BARRIER = b"\xff"
MARKED = bytes(0xFF if byte in PIECE_ENDS else byte for byte in range(256))
FIRST_HALF = -1 << 32
# The primes of XXH64.
P1, P2, P3, P4, P5 = (
    np.uint64(p)
    for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
EDGE = ["w1", "w23", "w4"]
COUNTS = "w1 long, w23 long, w4 long, n long"


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = _turned((seed + P5 + np.uint64(8)) ^ (_turned(x * P2, 31) * P1), 27) * P1 + P4
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``pair_hash`` of two arrays of hashes; as all words' hashes are odd, a pair's is, too."""
    return (_hash_long(a, np.full(len(a), 42, dtype=np.uint64)) & ~np.uint64(1)) ^ b


def pair_hash(a: str, b: str) -> Column:
    """The hash of a pair of words, or the second word of a pair ``b`` whose first one is ``a``."""
    return F.xxhash64(a).bitwiseAND(F.lit(-2)).bitwiseXOR(F.col(b))


class _Words(dict):
    """Hashes of the words of one language; a bounded number of short ones is remembered."""

    def __init__(self, language: str) -> None:
        super().__init__({BARRIER: 0})
        self.seed = xxhash.xxh64_intdigest(language.encode("utf-8", "surrogatepass"))
        self.told: set[bytes] = {BARRIER}

    def hash(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word, self.seed) | 1

    def __missing__(self, word: bytes) -> int:
        value = self.hash(word)
        if len(word) <= HELD_WORD_BYTES and len(self) < HELD_WORDS:
            self[word] = value
        return value


def segments(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, with ``BARRIER`` between pieces; about a mebibyte at a time."""
    start = 0
    while start < len(text):
        stop = len(text)
        if stop - start > SEGMENT_BYTES:
            at = text.find(b" ", start + SEGMENT_BYTES)
            stop = stop if at < 0 else at
        yield text[start:stop].lower().translate(MARKED).replace(BARRIER, b" \xff ").split()
        start = stop


def _batch_words(batch: pa.RecordBatch, vocabularies: dict[str, _Words]) -> Iterator[tuple[str, list[bytes], _Words, bool]]:
    """Language, words, their vocabulary and whether a text begins, by segment of rows ``(lang, text)``."""
    for language, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
        if language not in vocabularies:
            if len(vocabularies) >= HELD_LANGUAGES:
                vocabularies.clear()
            vocabularies[language] = _Words(language)
        words = vocabularies[language]
        for k, found in enumerate(segments(text or b"")):
            yield language, found, words, k == 0


def grams(words: np.ndarray) -> list[list[np.ndarray]]:
    """Columns of rows ``(w1, w23, w4, w2)`` of the words of pieces, 0 between pieces and three at the end, from the second on.

    Edges; nodes that end a piece, without ``w4``; first pairs, ``w23`` alone; last two words, ``w1`` alone. ``w2``
    is the first word of ``w23``.
    """
    before, w1, w2, w3, w4 = words[:-4], words[1:-3], words[2:-2], words[3:-1], words[4:]
    pair_at = np.flatnonzero((before == 0) & (w1 > 0) & (w2 > 0))
    short = w1[(w1 > 0) & ((w2 == 0) | (w3 == 0))]
    node_at = np.flatnonzero((w1 > 0) & (w2 > 0) & (w3 > 0))
    none = np.zeros(max(len(pair_at), len(short)), dtype=np.uint64)
    return [
        [w1[node_at], pair_hashes(w2[node_at], w3[node_at]), w4[node_at], w2[node_at]],
        [none[: len(pair_at)], pair_hashes(w1[pair_at], w2[pair_at]), none[: len(pair_at)], w1[pair_at]],
        [short, *[none[: len(short)]] * 3],
    ]


def summed(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Equal rows of ``held`` added up, as far as they meet in the order of some bits; ``held`` is emptied column by column.

    The order is by outer words, so that what a shuffle compresses together is alike. Numbers of rows have the first
    half of the pair's first word in front; of rows with one pair, one has it at least, most others 0.
    """
    columns = []
    for _ in range(4):
        columns.append(np.concatenate([part.pop(0) for part in held]))
    held.clear()
    w1, w23, w4, _ = columns
    order = np.where(w1 == 0, w23, w1) >> np.uint64(32) << np.uint64(32)
    order |= np.where(w4 == 0, w23, w4) >> np.uint64(44) << np.uint64(12)
    order |= (w23 >> np.uint64(1)) & np.uint64(0xFFF)
    del w1, w23, w4
    order = np.argsort(order)
    fresh = np.zeros(len(order), dtype=bool)
    fresh[:1] = True
    for k, column in enumerate(columns):
        columns[k] = column = column[order]
        if k < 3:
            fresh[1:] |= column[1:] != column[:-1]
    del order
    begins = np.flatnonzero(fresh)
    n = np.diff(np.append(begins, len(fresh)))
    for k, column in enumerate(columns):
        columns[k] = column[begins]
    w23, first = columns[1], columns[3]
    slot = w23 >> np.uint64(64 - SLOT_BITS)
    teller = np.empty(1 << SLOT_BITS, dtype=np.int32)
    teller[slot] = np.arange(len(slot), dtype=np.int32)
    teller = teller[slot]
    told = (w23[teller] == w23) & (teller != np.arange(len(slot)))
    first[told] = 0
    return [*(column.view(np.int64) for column in columns[:3]), (first.view(np.int64) & FIRST_HALF) | n]


def _grams(docs: DataFrame) -> DataFrame:
    """``(w1, w4, w23, n)`` of the texts, added up by task; ``n`` as of ``summed``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies: dict[str, _Words] = {}
        held: list[list[np.ndarray]] = []
        tail = np.zeros(1, dtype=np.uint64)

        def flush() -> pa.RecordBatch:
            w1, w23, w4, n = summed(held)
            return pa.RecordBatch.from_arrays([pa.array(column) for column in (w1, w4, w23, n)], names=["w1", "w4", "w23", "n"])

        none = np.zeros(3, dtype=np.uint64)
        waiting: list[np.ndarray] = []
        for batch in batches:
            for _, found, known, begins in _batch_words(batch, vocabularies):
                if begins:
                    waiting.append(none)
                waiting.append(np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found)))
                if sum(map(len, waiting)) > HELD_GRAMS:
                    # The last four words wait for those that follow; the one before them is behind.
                    together = np.concatenate([tail, *waiting])
                    held += grams(together)
                    tail, waiting = together[-4:].copy(), []
                    yield flush()
        held += grams(np.concatenate([tail, *waiting, none, none]))
        if sum(len(rows[0]) for rows in held):
            yield flush()

    return docs.mapInArrow(count, "w1 long, w4 long, w23 long, n long")


class _RunSums:
    """Sums over runs of equal keys that come in order, batch by batch; the last run waits for the next batch.

    Columns are ``keys`` keys, a number to add, and words that are one value or 0 within a run.
    """

    def __init__(self, keys: int) -> None:
        self.keys = keys
        self.held: list[np.ndarray] = []

    def add(self, columns: list[np.ndarray], last: bool = False) -> list[np.ndarray]:
        if self.held:
            columns = [np.concatenate(both) for both in zip(self.held, columns, strict=True)]
        if not len(columns[0]):
            return columns
        keys = np.stack(columns[: self.keys])
        begins = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
        sums = [*keys[:, begins], np.add.reduceat(columns[self.keys], begins)]
        sums += [np.bitwise_or.reduceat(column, begins) for column in columns[self.keys + 1 :]]
        if last:
            return sums
        self.held = [column[-1:] for column in sums]
        return [column[:-1] for column in sums]


def _shuffled(frame: DataFrame) -> DataFrame:
    """A side of a join that is dealt out by key at every size.

    Tables of this module pack well: what Spark takes for 10 MB by its files has eight times that as a hash table on the driver.
    """
    return frame.hint("merge")


def _flows(rows: DataFrame, common: np.ndarray, min_count: int) -> DataFrame:
    """``(size, w1, w23, w4, n)``: edges, nodes and pairs that are frequent, and parts of the counts of words.

    A pair has the first half of its first word as ``w1``.

    Rows are dealt out by pair, those of the at most 2,000 ``common`` pairs by word, too: the counts of
    these are parts as well, and a part may have 0 for the first word.
    """
    heavy = rows.sparkSession.sparkContext.broadcast(common)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, nodes, pairs = _RunSums(3), _RunSums(2), _RunSums(1)
        flow: list[tuple[np.ndarray, np.ndarray]] = []

        def rows_of(size: int, n: np.ndarray, w1=None, w23=None, w4=None) -> pa.RecordBatch:
            none = np.zeros(len(n), dtype=np.int64)
            columns = [none + size, *(none if column is None else column for column in (w1, w23, w4)), n]
            return pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names=["size", *EDGE, "n"])

        def words() -> pa.RecordBatch:
            w1, index = np.unique(np.concatenate([f[0] for f in flow]), return_inverse=True)
            n = np.zeros(len(w1), dtype=np.int64)
            np.add.at(n, index, np.concatenate([f[1] for f in flow]))
            flow.clear()
            return rows_of(1, n, w1)

        def feed(w1: np.ndarray, w4: np.ndarray, w23: np.ndarray, n: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            first, n = n & FIRST_HALF, n & ~FIRST_HALF
            paired = w23 != 0
            pair, f, first = pairs.add([w23[paired], n[paired], first[paired]], last)
            often = (f >= min_count) | np.isin(pair, heavy.value)
            yield rows_of(2, f[often], first[often], pair[often])
            w23, w1, w4, n = edges.add([w23, w1, w4, n], last)
            often = (w4 != 0) & (n >= min_count)
            yield rows_of(4, n[often], w1[often], w23[often], w4[often])
            flow.append((w1[w23 == 0], n[w23 == 0]))
            w23, w1, n = nodes.add([column[w23 != 0] for column in (w23, w1, n)], last)
            often = (w1 != 0) & (n >= min_count)
            yield rows_of(3, n[often], w1[often], w23[often])
            flow.append((w1[w1 != 0], n[w1 != 0]))
            if last or sum(len(f[0]) for f in flow) > HELD_GRAMS:
                yield words()

        empty = np.empty(0, dtype=np.int64)
        for batch in batches:
            yield from feed(*(column.to_numpy() for column in batch.columns), False)
        yield from feed(*[empty] * 4, True)

    outer = (F.col("w23") == 0) | F.col("w23").isin(common.tolist())
    dealt = rows.repartition("w23", F.when(outer, F.col("w1"))).sortWithinPartitions("w23", "w1", "w4")
    return dealt.mapInArrow(walk, f"size long, {COUNTS}")


def _spellings(docs: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``words`` ``(w, f1)`` with ``(lang, s)``, and ``(lang, n)``: the words of each language.

    The words' map of bits has a bounded size; what it lets pass by chance goes in a join.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bit_words(bit_map(words, "w")))
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64()]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies: dict[str, _Words] = {}
        for batch in batches:
            out: list[tuple] = []
            totals: dict[str, int] = {}
            for language, found, known, _ in _batch_words(batch, vocabularies):
                totals[language] = totals.get(language, 0) + len(found) - found.count(BARRIER)
                fresh = list(set(found).difference(known.told))
                hashes = np.fromiter(map(known.hash, fresh), dtype=np.uint64, count=len(fresh)).view(np.int64)
                wanted = in_bit_map(bits.value, hashes)
                out += [(int(hashes[k]), language, fresh[k], None) for k in np.flatnonzero(wanted).tolist()]
                # Wanted words are told once, others not looked at again; half of the room is for wanted ones alone.
                room = len(known.told) < TOLD_WORDS // 2
                if room or len(known.told) < TOLD_WORDS and wanted.any():
                    both = zip(fresh, wanted.tolist(), strict=True)
                    known.told.update(word for word, is_wanted in both if (room or is_wanted) and len(word) <= HELD_WORD_BYTES)
            out += [(0, language, None, n) for language, n in totals.items()]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["w", "lang", "s", "n"])

    found = docs.mapInArrow(spell, "w long, lang string, s binary, n long")
    found = stored(found.groupBy("w", "lang").agg(F.min("s").alias("s"), F.sum("n").alias("n")), "spellings")
    return found.filter("w <> 0").drop("n").join(_shuffled(words), "w"), found.filter("w = 0").select("lang", "n")


def _path_heads(edges: DataFrame) -> DataFrame:
    """``(w1, w23, w4, head, place)``: the first edge of every edge's unary path and the steps to it.

    ``edges`` has ``to1, to23``, the node that it leads to. A path goes on through a node with one frequent edge in and
    one out, unless its hash cuts: every 64th node does, so that a path's row stays short at any length of
    repeated text. Every round doubles the steps looked back. Edges on cycles without a cut are paths of their own.
    """
    into = edges.groupBy("to1", "to23").agg(F.count("*").alias("n_in"), *(F.max(name).alias(f"up_{name}") for name in EDGE))
    out = edges.groupBy("w1", "w23").agg(F.count("*").alias("n_out"))
    inner = into.withColumnsRenamed({"to1": "w1", "to23": "w23"}).join(_shuffled(out), ["w1", "w23"])
    inner = inner.filter((F.col("n_in") == 1) & (F.col("n_out") == 1) & (F.pmod(F.xxhash64("w1", "w23"), F.lit(PATH_CUT)) != 0))
    steps = edges.select(*EDGE).join(_shuffled(inner), ["w1", "w23"], "left")
    heads = F.col("n_in").isNull()
    steps = steps.select(*EDGE, *(F.coalesce(f"up_{name}", name).alias(f"up_{name}") for name in EDGE), F.when(heads, 0).otherwise(1).alias("place"), heads.alias("is_head"))
    steps = stored(steps, "steps")
    above = [F.col(name).alias(f"up_{name}") for name in EDGE]
    for _ in range(PATH_ROUNDS):
        far = steps.select(*above, *(F.col(f"up_{name}").alias(f"far_{name}") for name in EDGE), F.col("place").alias("more"), F.col("is_head").alias("above_head"))
        joined = steps.join(_shuffled(far), [f"up_{name}" for name in EDGE])
        if joined.filter("NOT above_head").isEmpty():
            break
        steps = stored(joined.select(*EDGE, *(F.col(f"far_{name}").alias(f"up_{name}") for name in EDGE), (F.col("place") + F.col("more")).alias("place"), "is_head"), "steps")
    ends = steps.select(*above, F.col("is_head").alias("whole"))
    return steps.join(_shuffled(ends), [f"up_{name}" for name in EDGE]).select(
        *EDGE,
        F.when(F.col("whole"), F.struct(*(F.col(f"up_{name}").alias(name) for name in EDGE))).otherwise(F.struct(*EDGE)).alias("head"),
        F.when(F.col("whole"), F.col("place")).otherwise(0).alias("place"),
    )


def _joined(words: list[str]) -> Column:
    return F.concat(*(part for word in words for part in (F.lit(b" "), F.col(word)))).substr(2, 1 << 30).cast("string")


def _scored(frame: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` by the cut of least score, then of fewest words; products are exact."""
    options = [
        f"struct(CAST(a AS DECIMAL(20,0)) * {SCALE} div (CAST({left} AS DECIMAL(20,0)) + CAST({right} AS DECIMAL(20,0))) AS score, "
        f"{k} AS k, {left} AS l, {right} AS r)"
        for k, (left, right) in enumerate(cuts)
    ]
    best = frame.withColumn("best", F.expr(f"array_min(array({', '.join(options)}))"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def _not_contained(frame: DataFrame, longer: DataFrame, keys: list[str], contained: int) -> DataFrame:
    """Rows without a longer phrase that occurs ``contained`` per cent as often; ``longer`` is ``(*keys, of)``."""
    most = longer.groupBy(*keys).agg(F.max("of").alias("of"))
    share = F.coalesce("of", F.lit(0)).cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * contained
    return frame.join(_shuffled(most), keys, "left").filter(~share)


def _paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row per unary path: its words, and how often its phrases of 1 to 4 words occur, in order."""
    placed = edges.join(_shuffled(_path_heads(edges)), EDGE)
    steps = F.array_sort(F.collect_list(F.struct("place", "s4", "f1_4", "f2_34", "f3_to", "n")))
    paths = placed.groupBy("head").agg(steps.alias("steps"))
    first = nodes.withColumnsRenamed({"w1": "h1", "w23": "h23"})
    paths = paths.join(_shuffled(first), (F.col("head.w1") == F.col("h1")) & (F.col("head.w23") == F.col("h23")))
    return paths.select(
        "lang",
        F.concat(F.array("s1", "s2", "s3"), "steps.s4").alias("words"),
        F.concat(F.array("f1_1", "f1_2", "f1_3"), "steps.f1_4").alias("f1"),
        F.concat(F.array("f2_12", "f2_23"), "steps.f2_34").alias("f2"),
        F.concat(F.array("f3"), "steps.f3_to").alias("f3"),
        F.col("steps.n").alias("f4"),
    )


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, contained: int = CONTAINED) -> DataFrame:
    """The ``top`` phrases of 2 to 4 words per language: ``(lang, rank, phrase, a, l, r, n, score)``.

    Texts are lower-cased (A-Z) and cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at spaces and
    tabs. A phrase counts if it occurs ``min_count`` times within pieces of its language, overlaps included
    (``a``). Cutting it in two gives ``l`` and ``r``, the counts of its parts, and the score
    ``floor(2000000 * a / (l + r))``; the cut of least score counts, of equals that with the shortest first
    part. Phrases inside a longer one that occurs at least ``contained`` per cent as often are left out.
    Ranks are by score, then ``a``, both descending, then the phrase's bytes. ``n`` counts the language's words.

    The null language is ``und``; null and empty texts have no words; rows that repeat count as often; other columns are not
    looked at. Texts of any length are read a mebibyte at a time. No text, no row.

    The sample of about 20,000 documents only tells which pairs of words are so common that their edges must be
    spread over many tasks; every count is over all documents. No table is gathered on the driver but the common
    pairs, at most 2,000, and a map of bits of at most 4 MiB.
    """
    bounded_batches(docs.sparkSession)
    columns = [F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text")]
    texts = docs.select(*columns)
    sample = _grams(sampled(docs, SAMPLED_DOCS, "text").select(*columns)).filter("w23 <> 0")
    sample = stored(sample.groupBy("w23").agg(F.sum(F.col("n").bitwiseAND(F.lit(~FIRST_HALF))).alias("n")).filter("n > 20"), "common-pairs")
    total = sample.agg(F.sum("n")).first()[0] or 0
    common = sample.filter(F.col("n") > total // HEAVY_SHARE).select("w23").toPandas()
    counts = stored(_flows(_grams(texts), common["w23"].to_numpy(dtype=np.int64), min_count), "flows")
    words = counts.filter("size = 1").groupBy(F.col("w1").alias("w")).agg(F.sum("n").alias("f1")).filter(F.col("f1") >= min_count)
    words, n_words = _spellings(texts, stored(words, "words"))
    words = stored(words, "spelled-words")

    def with_word(frame: DataFrame, k: int) -> DataFrame:
        found = [F.col("w").alias(f"w{k}"), F.col("f1").alias(f"f1_{k}"), F.col("s").alias(f"s{k}")]
        return frame.join(_shuffled(words.select(*found)), f"w{k}")

    # Most pairs are one row; those of common pairs are parts, of which some tell the first word.
    pairs = counts.filter("size = 2").groupBy("w23").agg(F.sum("n").alias("f2"), F.bit_or("w1").alias("half"))
    pairs = pairs.filter(F.col("f2") >= min_count)
    first = words.select("lang", F.col("w").alias("w2"), F.col("f1").alias("f1_2"), F.col("s").alias("s2"), F.col("w").bitwiseAND(F.lit(FIRST_HALF)).alias("half"))
    pairs = pairs.join(_shuffled(first), "half").drop("half").withColumn("w3", pair_hash("w2", "w23"))
    pairs = stored(with_word(pairs, 3), "spelled-pairs")
    inner = pairs.withColumnRenamed("f2", "f2_23")
    nodes = counts.filter("size = 3").select("w1", "w23", F.col("n").alias("f3")).join(_shuffled(inner), "w23")
    nodes = with_word(nodes, 1).withColumn("w12", pair_hash("w1", "w2"))
    nodes = nodes.join(_shuffled(pairs.select(F.col("w23").alias("w12"), F.col("f2").alias("f2_12"))), "w12")
    nodes = stored(nodes, "spelled-nodes")

    edges = counts.filter("size = 4").select(*EDGE, "n").join(_shuffled(pairs.select("w23", "w2", "w3")), "w23")
    edges = with_word(edges, 4).select(*EDGE, "n", "s4", "f1_4", F.col("w2").alias("to1"), pair_hash("w3", "w4").alias("to23"))
    edges = edges.join(_shuffled(pairs.select(F.col("w23").alias("to23"), F.col("f2").alias("f2_34"))), "to23")
    onward = nodes.select(F.col("w1").alias("to1"), F.col("w23").alias("to23"), F.col("f3").alias("f3_to"))
    edges = edges.join(_shuffled(onward), ["to1", "to23"])
    edges = stored(edges, "spelled-edges")

    at = [f"words[i + {k}]" for k in range(4)]
    four = _paths(edges, nodes).select("*", F.posexplode("f4").alias("i", "a"))
    four = four.select(
        "lang", "a", *(F.expr(word).alias(f"s{k}") for k, word in enumerate(at, 1)),
        *(F.expr(part).alias(name) for name, part in (
            ("l1", "f1[i]"), ("r1", "f3[i + 1]"), ("l2", "f2[i]"), ("r2", "f2[i + 2]"), ("l3", "f3[i]"), ("r3", "f1[i + 3]"),
        )),
    )
    four = four.withColumn("phrase", _joined(["s1", "s2", "s3", "s4"]))
    ends = edges.select("w1", "w23", F.col("n").alias("of")).union(edges.select("to1", "to23", "n"))
    three = _not_contained(nodes.withColumn("a", F.col("f3")), ends, ["w1", "w23"], contained).withColumn("phrase", _joined(["s1", "s2", "s3"]))
    # A phrase of four that holds a pair holds a phrase of three that does and occurs as often at least.
    ends = nodes.select("w23", F.col("f3").alias("of")).union(nodes.select("w12", "f3"))
    two = _not_contained(pairs.withColumn("a", F.col("f2")), ends, ["w23"], contained).withColumn("phrase", _joined(["s2", "s3"]))
    found = reduce(DataFrame.union, [
        _scored(four, [("l1", "r1"), ("l2", "r2"), ("l3", "r3")]),
        _scored(three, [("f1_1", "f2_23"), ("f2_12", "f1_3")]),
        _scored(two, [("f1_2", "f1_3")]),
    ])
    # The best of each of many parts of a language first, so that no task ranks all its phrases.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return found.join(_shuffled(n_words), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
