"""Languages of texts: scripts narrow the candidates, and Viterbi with a switching penalty labels spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formlens.llm.common import bounded_batches, fresh_name, shipped, text_slices

BUCKETS = 1 << 16
SAMPLE_PER_LANGUAGE = 1_500
SWITCH_PENALTY = 8.0
WORD_LIMIT = 6.0
SCRIPT_SHARE = 0.005
SMOOTHING = 0.5
SLICE_ROWS = 2_000
SCORED_WORDS = 16_384
CELLS = 1 << 20
UNDETERMINED = "und"

# First code points of runs of one script; fixed values of the Unicode blocks. 0: no script of its own.
SCRIPTS = [
    (0x0000, 0), (0x0041, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 7),
    (0x0750, 6), (0x0780, 8), (0x07C0, 0), (0x08A0, 6), (0x0900, 9), (0x0980, 10), (0x0A00, 11), (0x0A80, 12),
    (0x0B00, 13), (0x0B80, 14), (0x0C00, 15), (0x0C80, 16), (0x0D00, 17), (0x0D80, 18), (0x0E00, 19), (0x0E80, 20),
    (0x0F00, 21), (0x1000, 22), (0x10A0, 23), (0x1100, 24), (0x1200, 25), (0x13A0, 0), (0x1780, 26), (0x1800, 27),
    (0x18B0, 0), (0x1C80, 3), (0x1C90, 23), (0x1CC0, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1),
    (0x2C80, 0), (0x2DE0, 3), (0x2E00, 0), (0x3040, 28), (0x30A0, 28), (0x3100, 29), (0x3130, 24), (0x3190, 0),
    (0x31F0, 28), (0x3200, 0), (0x3400, 29), (0xA000, 0), (0xA640, 3), (0xA6A0, 0), (0xA720, 1), (0xA800, 0),
    (0xAC00, 24), (0xD7B0, 0), (0xF900, 29), (0xFB00, 1), (0xFB10, 0), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6),
    (0xFF00, 0), (0xFF21, 1), (0xFF66, 28), (0xFFA0, 24), (0x10000, 0), (0x20000, 29), (0x30000, 29), (0x40000, 0),
]
STARTS = np.array([start for start, _ in SCRIPTS])
SCRIPT_OF = np.array([script for _, script in SCRIPTS])
N_SCRIPTS = 30
# Scripts written without spaces: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han; fixed values as above.
UNSPACED = np.array([19, 20, 21, 22, 26, 28, 29])
PIECE = 2
LATIN = re.compile("[A-Za-z\u00AA\u00B5\u00BA\u00C0-\u02FF]*")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows whose language is never learnt: CRC-32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Words:
    """The words of texts: distinct ones in lower case without other than letters, and each text's in order.

    A word is what stands between white space, cut where the script changes and, in scripts written
    without spaces, after every two letters.
    """

    spelled: list[str]
    codes: np.ndarray
    bounds: np.ndarray


def letters_of(part: str) -> str:
    part = NOT_LETTERS.sub("", part)
    return part if part.isalpha() else "".join(filter(str.isalpha, part))


def cut_by_script(part: str) -> list[str]:
    """The words of letters without white space; a letter of no script goes with the one before it."""
    if LATIN.fullmatch(part):
        return [part]
    codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    script = SCRIPT_OF[np.searchsorted(STARTS, codes, side="right") - 1]
    known = np.flatnonzero(script)
    if not len(known):
        return [part]
    places = np.arange(len(script))
    script = script[known[np.maximum(np.searchsorted(known, places, side="right") - 1, 0)]]
    changes = np.concatenate(([True], script[1:] != script[:-1]))
    within = places - np.maximum.accumulate(np.where(changes, places, 0))
    cuts = np.flatnonzero(changes | (np.isin(script, UNSPACED) & (within % PIECE == 0))).tolist()
    return [part[low:high] for low, high in zip(cuts, [*cuts[1:], len(part)], strict=True)]


def words_of(texts: pa.Array) -> Words:
    split = pc.utf8_split_whitespace(pc.fill_null(texts, "").cast(pa.string()))
    bounds = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    spelled = [part.lower() for part in coded.dictionary.to_pylist()]
    spelled = [part if part.isalpha() else letters_of(part) for part in spelled]
    codes, bounds = coded.indices.to_numpy().astype(np.int64), bounds - bounds[0]
    pieces = [cut_by_script(part) for part in spelled]
    sizes = np.array([len(cut) for cut in pieces], dtype=np.int64)
    if not (sizes > 1).any():
        return Words(spelled, codes, bounds)
    numbers: dict[str, int] = {}
    flat = np.array([numbers.setdefault(piece, len(numbers)) for cut in pieces for piece in cut], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    # A part's use becomes the uses of its pieces, one after the other.
    ends = np.concatenate(([0], np.cumsum(sizes[codes])))
    shift = np.repeat(first[codes] - ends[:-1], sizes[codes])
    return Words(list(numbers), flat[np.arange(ends[-1]) + shift], ends[bounds])


def grams(spelled: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character n-grams of words with their edges: the word and the bucket of each; scripts of the words."""
    joined = " " + " ".join(spelled) + "  "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    space = codes == 32
    word = np.cumsum(space) - 1
    first = np.flatnonzero(space[:-1])
    script = SCRIPT_OF[np.searchsorted(STARTS, codes[first + 1], side="right") - 1]
    factors = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint64)
    owners, buckets = [], []
    for size in (1, 2, 3, 4):
        n = len(codes) - size + 1
        inner = ~space[:n] if size == 1 else ~space[1 : n + 1]
        for offset in range(2, size - 1):
            inner &= ~space[offset : n + offset]
        mixed = np.full(n, size, dtype=np.uint64)
        for offset in range(size):
            mixed = (mixed + codes[offset : n + offset]) * factors[offset]
            mixed ^= mixed >> np.uint64(29)
        owner = word[:n] if size == 1 else word[1 : n + 1]
        owners.append(owner[inner])
        buckets.append((mixed[inner] * factors[0] >> np.uint64(24)) % np.uint64(BUCKETS))
    owners, buckets = np.concatenate(owners), np.concatenate(buckets).astype(np.int64)
    kept = owners < len(spelled)
    return owners[kept], buckets[kept], script[: len(spelled)]


@dataclass
class LanguageModel:
    """Log chances of n-grams by language, and which languages write in which script."""

    languages: list[str]
    log_chances: np.ndarray
    candidates: np.ndarray

    def word_scores(self, spelled: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row per word: log chances relative to the best, bounded; which words have letters.

        Languages that don't write in the word's script are out; in a script of no language the word
        says nothing.
        """
        if len(spelled) > SCORED_WORDS:
            # Part by part, as the n-grams of many words take many times their memory.
            parts = [self.word_scores(spelled[low : low + SCORED_WORDS]) for low in range(0, len(spelled), SCORED_WORDS)]
            return tuple(np.concatenate(arrays) for arrays in zip(*parts, strict=True))
        n, size = len(spelled), len(self.languages)
        owners, buckets, script = grams(spelled)
        scores = np.column_stack(
            [np.bincount(owners, self.log_chances[buckets, k], minlength=n) for k in range(size)]
        ).reshape(n, size)
        allowed = self.candidates[:, script].T
        known = allowed.any(axis=1)
        scores = np.where(allowed, scores, -np.inf)
        scores[~known] = 0
        best = scores.max(axis=1, keepdims=True)
        lettered = np.array([bool(part) for part in spelled], dtype=bool)
        return np.maximum(scores - best, -WORD_LIMIT), lettered

    def label(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers and languages of all words with letters, and the bounds of the texts in these."""
        words = words_of(texts)
        scores, lettered = self.word_scores(words.spelled)
        kept = lettered[words.codes] if len(words.codes) else np.zeros(0, dtype=bool)
        before = np.concatenate(([0], np.cumsum(kept)))
        bounds = before[words.bounds]
        numbers = np.arange(len(kept)) - np.repeat(words.bounds[:-1], np.diff(words.bounds))
        codes = words.codes[kept]
        labels = np.zeros(len(codes), dtype=np.int64)
        sizes = np.diff(bounds)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        at = len(order)
        while at:
            # Texts of like length go through the recursion side by side, in a bounded number of cells.
            longest = int(sizes[order[at - 1]])
            low = max(0, at - max(1, min(512, CELLS // longest)))
            self._viterbi(scores, codes, bounds, order[low:at], longest, labels)
            at = low
        return numbers[kept], labels, bounds

    def _viterbi(
        self, scores: np.ndarray, codes: np.ndarray, bounds: np.ndarray, rows: np.ndarray, longest: int, labels: np.ndarray
    ) -> None:
        starts, sizes = bounds[rows], bounds[rows + 1] - bounds[rows]
        n, size = len(rows), len(self.languages)
        places = starts + np.minimum(np.arange(longest)[:, None], sizes - 1)
        inside = np.arange(longest)[:, None] < sizes
        picked = codes[places]
        total = scores[picked[0]]
        stays = np.ones((longest, n, size), dtype=bool)
        best = np.zeros((longest, n), dtype=np.int16)
        for step in range(1, longest):
            top = total.argmax(axis=1)
            switched = total[np.arange(n), top] - SWITCH_PENALTY
            stay = total >= switched[:, None]
            best[step], stays[step] = top, stay
            # A text that has ended keeps its totals.
            total = np.where(stay, total, switched[:, None]) + scores[picked[step]] * inside[step][:, None]
            if not inside[step].all():
                stays[step][~inside[step]] = True
        state = total.argmax(axis=1)
        across = np.arange(n)
        for step in range(longest - 1, -1, -1):
            now = inside[step]
            labels[places[step][now]] = state[now]
            if step:
                state = np.where(stays[step][across, state] | ~now, state, best[step])


def train(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """N-gram and script counts of about ``sample`` documents per language, chosen by hash; held-out ones are never read."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = rows.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(~held_out(F.col("doc_id")))
    counts = {row["lang"]: row["count"] for row in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros((0, N_SCRIPTS), dtype=bool))
    parts = 1 << 30
    shares = F.create_map(
        *[F.lit(x) for lang in languages for x in (lang, min(parts, parts * sample // counts[lang]))]
    )
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) < shares[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                chosen_rows = pa.array([i for i, other in enumerate(langs) if other == lang])
                words = words_of(batch.column(1).take(chosen_rows))
                uses = np.bincount(words.codes, minlength=len(words.spelled))
                owners, buckets, script = grams(words.spelled)
                lettered = np.array([bool(part) for part in words.spelled], dtype=bool)
                counted = np.bincount(buckets, uses[owners], minlength=BUCKETS)
                scripts = np.bincount(script[lettered], uses[lettered], minlength=N_SCRIPTS)
                both = np.concatenate((counted, scripts)).astype(np.int64)
                found[lang] = found[lang] + both if lang in found else both
        for lang, both in found.items():
            places = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(places)), pa.array(places), pa.array(both[places])], names=["lang", "place", "n"]
            )

    # At most (buckets + scripts) rows per language.
    table = chosen.mapInArrow(count, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros((len(languages), BUCKETS + N_SCRIPTS))
    row_of = {lang: k for k, lang in enumerate(languages)}
    rows_at = np.array([row_of[lang] for lang in table["lang"].to_pylist()], dtype=np.int64)
    totals[rows_at, table["place"].to_numpy()] = table["n"].to_numpy()
    by_gram, by_script = totals[:, :BUCKETS] + SMOOTHING, totals[:, BUCKETS:]
    log_chances = np.log(by_gram / by_gram.sum(axis=1, keepdims=True)).T
    candidates = by_script > SCRIPT_SHARE * by_script.sum(axis=1, keepdims=True)
    return LanguageModel(languages, np.ascontiguousarray(log_chances), candidates)


SPANS = T.ArrayType(
    T.StructType().add("first_word", T.IntegerType()).add("n_words", T.IntegerType()).add("lang", T.StringType())
)
SPAN = pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())])


def _spans(model: LanguageModel, texts: pa.Array) -> tuple[list, list, list]:
    """Language, score and spans of every text."""
    names, scores, spans = [], [], []
    if not model.languages:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts), [[]] * len(texts)
    numbers, labels, bounds = model.label(texts)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if low == high:
            names.append(UNDETERMINED)
            scores.append(0.0)
            spans.append([])
            continue
        own, at = labels[low:high], numbers[low:high]
        share = np.bincount(own, minlength=len(model.languages))
        top = int(share.argmax())
        names.append(model.languages[top])
        scores.append(float(share[top]) / (high - low))
        edges = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [high - low]))
        spans.append(
            [
                {"first_word": int(at[a]), "n_words": int(at[b - 1] - at[a]) + 1, "lang": model.languages[int(own[a])]}
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
            ]
        )
    return names, scores, spans


def label_languages(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """The documents with ``lang_pred``, ``lang_score`` and ``lang_spans``.

    Words are what stands between white space, without other characters than letters, cut where the script
    changes; in scripts written without spaces every two letters are a word. Each gets a score per language from its character n-grams, the languages of its script competing; the best
    sequence of languages, where every switch costs a penalty, gives the spans (first word and number
    of words, counted from 0, and language). The prediction is the language of most words, the first
    by name among equals, and the score its share of the words with letters.

    Null texts and texts without letters are ``und`` with score 0 and no spans, and so is every text
    if no language was learnt. ``keep`` names the columns to pass through (all by default); if some are
    called like a result column, that one gets underscores in front. Repeated rows fare alike; an
    empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    shared = shipped(docs.sparkSession, model, "language")
    keep = docs.columns if keep is None else keep
    source = docs.select(*(F.col(f"`{name}`") for name in keep))
    results = [fresh_name(source, name) for name in ("lang_pred", "lang_score", "lang_spans")]
    n_kept = len(keep)
    if "text" not in keep:
        source = docs.select(*(F.col(f"`{name}`") for name in keep), "text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, SLICE_ROWS):
                names, scores, spans = _spans(shared(), part.column("text"))
                arrays = [*part.columns[:n_kept], pa.array(names), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(SPAN))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names[:n_kept], *results])

    kept = [docs.schema[name] for name in keep]
    schema = T.StructType(
        [*kept, *(T.StructField(name, kind) for name, kind in zip(results, (T.StringType(), T.DoubleType(), SPANS), strict=True))]
    )
    return source.mapInArrow(label, schema)
