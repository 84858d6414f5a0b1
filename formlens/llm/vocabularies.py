"""Public tokenizers inside tasks: loaded once per worker process, with bounded memories of words."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from formlens.functions.process import per_process

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

MEMORY_BYTES = 64 << 20

# The letters and numbers among the first 256 code points, as the tokenizers' patterns class them.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
BYTE_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
)
# Python counts these as white space, the patterns don't.
ODD_SPACE = "\x1c\x1d\x1e\x1f"


def load(path: str):
    return per_process(("tokenizer", path), lambda: _load(path))


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def special_strings(tokenizer) -> list[str]:
    return [token.content for token in tokenizer.get_added_tokens_decoder().values()]


class Memory(dict):
    """Values by key, computed when first asked for; at most ``2 * limit`` are kept, those in use longest.

    Keys and values together take about ``2 * max_bytes`` at most, and what was added last; ``size_of`` tells
    the bytes of a value.
    """

    def __init__(self, compute, limit: int, max_bytes: int = MEMORY_BYTES, size_of=sys.getsizeof):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}
        self.max_bytes, self.size_of, self.held = max_bytes, size_of, 0

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self.keep([(key, value)])
        return value

    def keep(self, pairs: Iterable[tuple]) -> None:
        for key, value in pairs:
            self[key] = value
            self.held += sys.getsizeof(key) + self.size_of(value)
        if len(self) >= self.limit or self.held >= self.max_bytes:
            self.older = dict(self) if self.held <= 2 * self.max_bytes else {}
            self.clear()
            self.held = 0


SPACE, LETTER, NUMBER, OTHER = range(4)


def _byte_tables() -> tuple[np.ndarray, ...]:
    """Class and lower case of single bytes, and of the second byte after 0xC2 and after 0xC3."""
    classes, lower = np.full((3, 256), OTHER, dtype=np.uint8), np.tile(np.arange(256, dtype=np.uint8), (3, 1))
    for code in range(256):
        char = chr(code)
        kind = OTHER
        if char.isspace() and char not in ODD_SPACE:
            kind = SPACE
        elif re.match(f"[{LETTERS}]", char):
            kind = LETTER
        elif re.match(f"[{NUMBERS}]", char):
            kind = NUMBER
        raw = char.encode()
        row = len(raw) - 1 + (raw[0] == 0xC3)
        classes[row, raw[-1]] = kind
        if len(char.lower().encode()) == len(raw):
            lower[row, raw[-1]] = char.lower().encode()[-1]
    return classes, lower


CLASSES, LOWER = _byte_tables()


def latin_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words, digits and signs of texts within the first 256 code points, in lower case.

    Second: how many pieces the texts up to each one have. Runs of letters and of signs are pieces,
    every digit is one; an apostrophe that stands alone takes the ending of a contraction with it.
    """
    bounds, data = text_bytes(texts)
    if not len(data):
        return pa.array([], pa.string()), np.zeros(len(texts), dtype=np.int64)
    kinds, low = CLASSES[0][data], LOWER[0][data]
    for row, lead in ((1, 0xC2), (2, 0xC3)):
        first = np.flatnonzero(data == lead)
        kinds[first] = kinds[first + 1] = CLASSES[row][data[first + 1]]
        low[first + 1] = LOWER[row][data[first + 1]]
    fresh = kinds[1:] != kinds[:-1]
    fresh |= (kinds[1:] == NUMBER) & ((data[1:] & 0xC0) != 0x80)
    fresh = np.concatenate(([True], fresh))
    fresh[bounds[:-1][bounds[:-1] < len(data)]] = True
    starts = np.flatnonzero(fresh)
    stops = np.append(starts[1:], len(data))
    # An apostrophe alone, then letters of the same text: s t m d, or re ve ll, belong to the apostrophe.
    mark = np.flatnonzero((low[starts] == ord("'")) & (stops - starts == 1))
    mark = mark[mark + 1 < len(starts)]
    mark = mark[(kinds[starts[mark + 1]] == LETTER) & ~np.isin(starts[mark + 1], bounds)]
    if len(mark):
        after, size = starts[mark + 1], stops[mark + 1] - starts[mark + 1]
        one, two = low[after], low[np.minimum(after + 1, len(data) - 1)]
        takes = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8)).astype(np.int64)
        pair = one.astype(np.int64) * 256 + two
        takes[(size > 1) & np.isin(pair, [a * 256 + b for a, b in (b"re", b"ve", b"ll")])] = 2
        stops[mark] += takes
        starts[mark + 1] += takes
    kept = (kinds[np.minimum(starts, len(data) - 1)] != SPACE) & (stops > starts)
    starts, stops = starts[kept], stops[kept]
    offsets = np.concatenate(([0], np.cumsum(stops - starts))).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(low[kinds != SPACE]))
    return pieces, np.searchsorted(starts, bounds[1:])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the texts and all their bytes."""
    _, offsets, data = texts.cast(pa.string()).buffers()
    bounds = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return bounds - bounds[0], whole[bounds[0] : bounds[-1]]


def gathered(flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``codes`` out of ``flat``, whose runs have ``lengths``, in a row; and where each one stops."""
    if not len(codes):
        return flat[:0], np.zeros(0, dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    taken = lengths[codes]
    stops = np.cumsum(taken)
    shift = np.repeat(starts[codes] - (stops - taken), taken)
    return flat[shift + np.arange(stops[-1])], stops


class WordIds:
    """Ids of whole texts for the word vocabulary, which drops white space and marks the ends of words.

    Texts within the first 256 code points are cut into words here; each word is tokenised when
    first seen and remembered. Other texts are taken apart at white space and each part goes to the
    tokenizer; texts with special strings go to it whole.
    """

    def __init__(self, path: str, limit: int = 200_000):
        self.tokenizer = load(path)
        self.special = special_strings(self.tokenizer)
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, dtype=bool)
        self.ends[[i for word, i in words.items() if word.endswith("</w>")]] = True
        self.pieces = Memory(self._whole, limit)
        # For words that are cut and in lower case already.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _odd(self, text: str) -> bytes:
        if any(mark in text for mark in self.special) or any(space in text for space in ODD_SPACE):
            return self._whole(text)
        return b"".join(map(self.pieces.__getitem__, text.split()))

    def learn(self, words: list[str]) -> None:
        """Tokenise unknown words together; each one ends with an end-of-word id."""
        wanted = [word for word in words if word not in self.pieces and word not in self.pieces.older]
        for start in range(0, len(wanted), 4096):
            part = wanted[start : start + 4096]
            joined = self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(joined[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                raw, stops = ids.tobytes(), (4 * stops).tolist()
                self.pieces.keep(zip(part, map(raw.__getitem__, map(slice, [0, *stops], stops)), strict=False))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of every text, little-endian unsigned 32-bit; null is empty."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        bounds, data = text_bytes(texts)
        odd = np.zeros(len(texts), dtype=bool)
        odd[np.searchsorted(bounds, np.flatnonzero(data > 0xC3), side="right") - 1] = True
        for mark in self.special:
            odd |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        pieces, counts = latin_pieces(plain)
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        self.learn(words)
        known = [self.pieces[word] for word in words]
        lengths = np.array([len(value) // 4 for value in known], dtype=np.int64)
        ids, stops = gathered(np.frombuffer(b"".join(known), dtype="<u4"), lengths, coded.indices.to_numpy())
        ends = 4 * np.concatenate(([0], stops))[counts]
        raw, low, encoded = ids.tobytes(), 0, []
        for high in ends.tolist():
            encoded.append(raw[low:high])
            low = high
        for row in np.flatnonzero(odd).tolist():
            encoded[row] = self._odd(texts[row].as_py())
        return encoded


def word_ids(path: str) -> WordIds:
    return per_process(("word ids", path), lambda: WordIds(path))
