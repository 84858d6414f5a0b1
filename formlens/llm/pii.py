"""Personal data in texts: fixed patterns, and a skip-chain conditional random field that adds to them."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlens.llm.common import bounded_batches, sampled, shipped, texts_of

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]
SAMPLE_DOCUMENTS = 3_000
ROUNDS = 8
DAMPING = 0.3
CERTAIN = 0.9
AGREEMENT = 4.0
# Labels of what is often written in groups of digits: cards and phones.
GROUPED = {3, 4}
SLICE_BYTES = 256 << 10
BLOCK_LINKS = 1 << 16

# Patterns of the contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
# The same matches: digits and dots do not overlap, so a run of digits matches from its first digit or not at all.
IP_RUNS = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

NOT_DIGITS = re.compile(r"[^0-9]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# What may be a part of an entity: it holds a digit or an at sign. All else is none for sure.
CANDIDATE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
CONTEXT = re.compile(r"[A-Za-z]+[^A-Za-z0-9]*\Z")
EDGES = ".,;:!?\"'()[]{}<>=*#%&$"


def passes_luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        if place % 2:
            digit = digit * 2 - 9 * (digit > 4)
        total += digit
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL, found from the at signs: the pattern is only tried where it may match.

    Whether it matches depends on what follows the sign alone, as long as one character of the local
    part is before it; the leftmost match takes all of those after the last match.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        # The longest run of local characters up to the sign, not reaching into the last match.
        low = at
        while low > done and (ch := text[low - 1]).isascii() and (ch.isalnum() or ch in "._%+-"):
            low -= 1
        if low < at and (match := EMAIL.match(text, low)):
            yield low, match.end()
            done = match.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The spans of every kind: leftmost matches that don't overlap; those failing the check are dropped."""
    found: list[list[tuple[int, int]]] = [list(emails(text)), [], [], []]
    for match in IP_RUNS.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in match.group().split(".")):
            found[1].append(match.span())
    for match in CARD.finditer(text):
        digits = NOT_DIGITS.sub("", match.group())
        if 13 <= len(digits) <= 19 and passes_luhn(digits):
            found[2].append(match.span())
    if "+" in text:
        for match in PHONE.finditer(text):
            if 9 <= len(NOT_DIGITS.sub("", match.group())) <= 15:
                found[3].append(match.span())
    return found


@dataclass
class Graph:
    """Candidate tokens of some texts, and their links: neighbours in a text, and alike ones far apart."""

    texts: list[int]
    starts: list[int]
    stops: list[int]
    observed: np.ndarray
    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


FEATURES = [
    "always", "sign", "sign and dotted end", "sign alone", "plus", "dots 3", "dots other", "hyphens", "digits 1-2", "digits 3-4",
    "digits 5-8", "digits 9-12", "digits 13-15", "digits 16", "digits 17-19", "digits over 19", "letters", "luhn", "octets",
    "colon or slash", "groups", "hex", "word mail", "word phone", "word card", "word address", "word other",
]
CUES = {
    "word mail": ("mail", "email", "contact"), "word phone": ("tel", "phone", "call", "fax", "mobile"),
    "word card": ("card", "visa", "pay"), "word address": ("ip", "host", "address", "server"),
}
PLACE = {name: k for k, name in enumerate(FEATURES)}


def token_features(token: str, before: str) -> list[int]:
    """The numbers of a token's features; ``before`` is the text in front of it."""
    core = token.strip(EDGES)
    digits, letters = NOT_DIGITS.sub("", core), any(ch.isalpha() for ch in core)
    on = ["always"]
    if "@" in core:
        local, _, domain = core.partition("@")
        on.append("sign alone" if not local or not domain else "sign and dotted end" if DOMAIN.fullmatch(domain) else "sign")
    if token.startswith("+") or "+" in token[:2]:
        on.append("plus")
    dots = core.count(".")
    if dots:
        on.append("dots 3" if dots == 3 else "dots other")
    if "-" in core:
        on.append("hyphens")
    n = len(digits)
    for most, name in ((0, None), (2, "digits 1-2"), (4, "digits 3-4"), (8, "digits 5-8"), (12, "digits 9-12"),
                       (15, "digits 13-15"), (16, "digits 16"), (19, "digits 17-19"), (1 << 30, "digits over 19")):
        if n <= most:
            on += [name] * bool(name)
            break
    if letters:
        on.append("hex" if n and not re.search(r"[^0-9a-fA-F]", core) else "letters")
    if 13 <= n <= 19 and not letters and passes_luhn(digits):
        on.append("luhn")
    if dots == 3 and all(re.fullmatch("[0-9]{1,3}", part) and int(part) <= 255 for part in core.split(".")):
        on.append("octets")
    if re.search(r"[:/]", core):
        on.append("colon or slash")
    if re.fullmatch(r"\(?[0-9]+([ .-][0-9]+)+\)?", core):
        on.append("groups")
    word = CONTEXT.search(before[-24:])
    if word:
        cue = "".join(ch for ch in word.group().lower() if ch.isalpha())
        on.append(next((name for name, words in CUES.items() if any(cue.endswith(part) for part in words)), "word other"))
    return [PLACE[name] for name in on]


def likeness(token: str) -> list[str]:
    """Keys that tokens share when they are the same or similar: the spelling, the digits, the address's name."""
    core = token.strip(EDGES).lower()
    digits = NOT_DIGITS.sub("", core)
    keys = [f"t{core}"] if core else []
    if len(digits) >= 7:
        keys += [f"d{digits}", f"e{digits[-7:]}"]
    if "@" in core and core[0] != "@":
        keys.append(f"n{core.partition('@')[0]}")
    return keys


def build_graph(texts: list[str], spans: list[list[list[tuple[int, int]]]]) -> Graph:
    """The candidate tokens of all texts; ``spans`` give the labels that the patterns observe.

    A token that holds any of a span has the span's kind (the first listed). Alike tokens are linked
    in a row, each to the next one of its text that shares a key, so links grow with the tokens.
    """
    owners, starts, stops, labels = [], [], [], []
    on = bytearray()
    chain, skip = [], set()
    for row, text in enumerate(texts):
        last, seen, first = None, {}, 0
        marked = sorted((start, stop, k + 1) for k, found in enumerate(spans[row]) for start, stop in found)
        for match in CANDIDATE.finditer(text):
            start, stop = match.span()
            node = len(owners)
            token = match.group()
            owners.append(row)
            starts.append(start)
            stops.append(stop)
            while first < len(marked) and marked[first][1] <= start:
                first += 1
            touched, at = [], first
            while at < len(marked) and marked[at][0] < stop:
                touched += [marked[at][2]] * (marked[at][1] > start)
                at += 1
            labels.append(min(touched, default=0))
            marks = bytearray(len(FEATURES))
            for place in token_features(token, text[max(0, start - 24) : start]):
                marks[place] = 1
            on += marks
            if last is not None and text[stops[last] : start].isspace() and start - stops[last] == 1:
                chain.append((last, node))
            for key in likeness(token):
                if key in seen and (seen[key], node) not in chain[-1:]:
                    skip.add((seen[key], node))
                seen[key] = node
            last = node
    features = np.frombuffer(on, dtype=np.uint8).reshape(-1, len(FEATURES))
    pairs = [np.array(sorted(links), dtype=np.int64).reshape(-1, 2) for links in (chain, skip)]
    return Graph(owners, starts, stops, np.array(labels, dtype=np.int64), features, *pairs)


class SkipChainField:
    """Weights of a conditional random field with potentials for tokens, neighbours and alike tokens."""

    def __init__(self):
        n = len(LABELS)
        self.unary = np.zeros((len(FEATURES), n))
        self.chain = np.zeros((n, n))
        # Alike tokens agree until the texts say otherwise: weights are drawn to this, not to zero.
        self.likely = {"chain": np.zeros((n, n)), "skip": AGREEMENT * np.eye(n)}
        self.skip = self.likely["skip"].copy()

    def fit(self, graph: Graph, rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> None:
        """Pseudo-likelihood: each token's label given its features and the observed labels it is linked to."""
        n, size = graph.features.shape[0], len(LABELS)
        if not n:
            return
        one_hot = np.eye(size)[graph.observed]
        sides = []
        for links, name in ((graph.chain, "chain"), (graph.skip, "skip")):
            met = np.zeros((n, size))
            np.add.at(met, links[:, 0], one_hot[links[:, 1]])
            np.add.at(met, links[:, 1], one_hot[links[:, 0]])
            sides.append((name, met))
        # The rare kinds count as much as they would in even numbers, up to a tenfold weight.
        counts = np.bincount(graph.observed, minlength=size)
        weight = np.clip(np.sqrt(counts.max() / np.maximum(counts, 1)), 1, 10)[graph.observed]
        weight /= weight.sum()
        for _ in range(rounds):
            raw = graph.features @ self.unary + sum(met @ getattr(self, name) for name, met in sides)
            chance = np.exp(raw - raw.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            slope = (one_hot - chance) * weight[:, None]
            self.unary += rate * 10 * (graph.features.T @ slope - decay * self.unary)
            for name, met in sides:
                step = met.T @ slope
                table = getattr(self, name)
                setattr(self, name, table + rate * 10 * ((step + step.T) / 2 - decay * (table - self.likely[name])))

    def chances(self, graph: Graph) -> np.ndarray:
        """Label chances of all tokens by loopy message passing over both kinds of links."""
        n, size = graph.features.shape[0], len(LABELS)
        own = np.zeros((n, size))
        for start in range(0, n, BLOCK_LINKS):
            own[start : start + BLOCK_LINKS] = graph.features[start : start + BLOCK_LINKS].astype(np.float64) @ self.unary
        # What the patterns found stays: its label is certain.
        fixed = graph.observed > 0
        own[fixed] = -1e3
        own[fixed, graph.observed[fixed]] = 0
        links = np.concatenate((graph.chain, graph.skip))
        if not len(links):
            return _normal(own)
        source = np.concatenate((links[:, 0], links[:, 1]))
        target = np.concatenate((links[:, 1], links[:, 0]))
        back = np.roll(np.arange(len(source)), len(links))
        messages = np.zeros((len(source), size))
        # Links of one kind and direction share a table; their sums are made a block at a time.
        ends = np.cumsum([0, len(graph.chain), len(graph.skip), len(graph.chain), len(graph.skip)]).tolist()
        blocks = [
            (table, slice(start, min(start + BLOCK_LINKS, stop)))
            for table, low, stop in zip((self.chain, self.skip, self.chain.T, self.skip.T), ends, ends[1:])
            for start in range(low, stop, BLOCK_LINKS)
        ]
        for _ in range(ROUNDS):
            total = own.copy()
            np.add.at(total, target, messages)
            before, messages = messages, np.empty_like(messages)
            for table, part in blocks:
                # What the target sent does not come back to it.
                sent = (total[source[part]] - before[back[part]])[:, :, None] + table
                top = sent.max(axis=1, keepdims=True)
                fresh = top[:, 0] + np.log(np.exp(sent - top).sum(axis=1))
                fresh -= fresh.max(axis=1, keepdims=True)
                messages[part] = DAMPING * before[part] + (1 - DAMPING) * fresh
        total = own.copy()
        np.add.at(total, target, messages)
        return _normal(total)


def _normal(raw: np.ndarray) -> np.ndarray:
    chance = np.exp(raw - raw.max(axis=1, keepdims=True)) if len(raw) else raw
    return chance / chance.sum(axis=1, keepdims=True)


def plausible(kind: int, token: str) -> bool:
    """Whether an added token can be of its kind at all."""
    core, digits = token.strip(EDGES), len(NOT_DIGITS.sub("", token))
    if any(ch.isalpha() for ch in core) and kind != 1:
        return False
    return [False, "@" in core, core.count(".") == 3, 13 <= digits <= 19, 7 <= digits <= 15][kind]


def all_spans(texts: list[str], field: SkipChainField) -> tuple[list, list]:
    """Base spans and added spans of every text, by kind."""
    base = [base_spans(text) for text in texts]
    added: list[list[list[tuple[int, int]]]] = [[[] for _ in KINDS] for _ in texts]
    graph = build_graph(texts, base)
    if len(graph.texts):
        chances = field.chances(graph)
        label = chances.argmax(axis=1)
        linked = np.zeros(len(label), dtype=bool)
        if len(graph.skip):
            a, b = graph.skip[:, 0], graph.skip[:, 1]
            alike = label[a] == label[b]
            np.logical_or.at(linked, a[alike], True)
            np.logical_or.at(linked, b[alike], True)
        sure = np.flatnonzero((label > 0) & (graph.observed == 0) & (chances.max(axis=1) >= CERTAIN)).tolist()
        for run in runs(graph, texts, sure, label):
            text, kind = texts[graph.texts[run[0]]], int(label[run[0]])
            tokens = [(graph.starts[node], graph.stops[node]) for node in run]
            for first, stop in segments(kind, text, tokens):
                if linked[run[first:stop]].any():
                    start, end = tokens[first][0], tokens[stop - 1][1]
                    span = text[start:end]
                    start += len(span) - len(span.lstrip(EDGES))
                    added[graph.texts[run[0]]][kind - 1].append((start, end - (len(span) - len(span.rstrip(EDGES)))))
    return base, added


def runs(graph: Graph, texts: list[str], nodes: list[int], label: np.ndarray) -> Iterator[list[int]]:
    """Cards and phones: the tokens of one label with one space in between, and no mark that ends a phrase. Others: each token."""
    run: list[int] = []
    for node in nodes:
        text = texts[graph.texts[node]]
        follows = (
            run and run[-1] == node - 1 and label[run[-1]] == label[node] and label[node] in GROUPED
            and graph.texts[run[-1]] == graph.texts[node] and text[graph.stops[run[-1]] : graph.starts[node]] == " "
            and text[graph.stops[run[-1]] - 1] not in ",.;:!?"
        )
        if run and not follows:
            yield run
            run = []
        run.append(node)
    if run:
        yield run


def segments(kind: int, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a run of tokens, as first and stop, that have the makings of their kind.

    Tokens that all have them alone stay alone. Otherwise as many tokens as possible are in some part,
    in as few parts as possible, of digits as even as possible.
    """
    n = len(tokens)
    if all(plausible(kind, text[start:stop]) for start, stop in tokens):
        return [(k, k + 1) for k in range(n)]
    # By the number of tokens so far: tokens left out, parts, unevenness; and where the last part begins.
    best: list[tuple[tuple[int, int, int], int]] = [((0, 0, 0), 0)]
    for stop in range(1, n + 1):
        (out, parts, uneven), _ = best[stop - 1]
        options = [((out + 1, parts, uneven), stop)]
        # Every token has a digit, so a part has no more tokens than the most digits of a kind.
        for first in range(max(0, stop - 19), stop):
            span = text[tokens[first][0] : tokens[stop - 1][1]]
            if plausible(kind, span):
                (out, parts, uneven), _ = best[first]
                size = len(NOT_DIGITS.sub("", span))
                options.append(((out, parts + 1, uneven + size * size), first))
        best.append(min(options))
    chosen, stop = [], n
    while stop:
        first = best[stop][1]
        if first < stop:
            chosen.append((first, stop))
        stop = min(first, stop - 1)
    return chosen[::-1]


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, found in zip(KINDS, spans, strict=True) for a, b in sorted(found))


def train(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> SkipChainField:
    """A field fitted on about ``sample`` documents with candidates, chosen by hash, labelled by the patterns."""
    bounded_batches(docs.sparkSession)
    field = SkipChainField()
    texts = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]"))
    chosen = sampled(texts, sample, "doc_id", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = texts_of(batch)
            graph = build_graph(own, [base_spans(text) for text in own])
            yield pa.RecordBatch.from_pydict(
                {
                    "observed": pa.array([graph.observed.astype("<i8").tobytes()]),
                    "features": pa.array([np.packbits(graph.features.astype(bool), axis=1).tobytes()]),
                    "chain": pa.array([graph.chain.astype("<i8").tobytes()]),
                    "skip": pa.array([graph.skip.astype("<i8").tobytes()]),
                }
            )

    schema = "observed binary, features binary, chain binary, skip binary"
    rows = chosen.mapInArrow(extract, schema).toArrow().to_pylist()
    parts_of = defaultdict(list)
    at = 0
    for row in sorted(rows, key=lambda row: row["features"] + row["observed"]):
        observed = np.frombuffer(row["observed"], dtype="<i8")
        bits = np.frombuffer(row["features"], dtype=np.uint8).reshape(len(observed), -1)
        parts_of["observed"].append(observed)
        parts_of["features"].append(np.unpackbits(bits, axis=1)[:, : len(FEATURES)].astype(np.float64))
        for name in ("chain", "skip"):
            parts_of[name].append(np.frombuffer(row[name], dtype="<i8").reshape(-1, 2) + at)
        at += len(observed)
    if at:
        whole = {name: np.concatenate(found) for name, found in parts_of.items()}
        field.fit(Graph([], [], [], whole["observed"], whole["features"], whole["chain"], whole["skip"]))
    return field


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in a row of about ``SLICE_BYTES`` of text, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    stops = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES, append=-1)) + 1
    for start, stop in zip([0, *stops], stops):
        yield batch.slice(start, stop - start)


def find_personal_data(docs: DataFrame, field: SkipChainField) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)`` of every document.

    The patterns' spans always stay; ``n_*`` count them and ``base_sha256`` is the SHA-256 of their
    list. Tokens that hold a digit or an at sign and touch no such span may be added: the field labels
    them together with their neighbours and with the same or similar tokens anywhere in the document,
    whose potentials pull them to one label. A token is added if its label is at least 0.9 certain, an
    alike token agrees, and it has the makings of its kind. Tokens of a card or phone written in groups
    (one space in between) are one span, which needs the makings as a whole and one token with an alike
    one. Documents without any pattern match are labelled, too. ``spans`` lists all of them as
    ``kind:start:end`` by kind and start, in code points, and ``n_added`` counts the added ones.

    Null texts are empty and have no spans (the SHA-256 of the empty string). Null and repeated ids and
    repeated rows each get their own row. An empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = shipped(docs.sparkSession, field, "pii")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                base, added = all_spans(texts_of(part), shared())
                counts = [pa.array([len(found[k]) for found in base], pa.int64()) for k in range(len(KINDS))]
                digests = [hashlib.sha256(joined(found).encode()).hexdigest() for found in base]
                every = [joined([a + b for a, b in zip(*both, strict=True)]) for both in zip(base, added, strict=True)]
                n_added = [sum(map(len, found)) for found in added]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array(digests), pa.array(every), pa.array(n_added, pa.int64())],
                    names=["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans", "n_added"],
                )

    counted = ", ".join(f"n_{kind} long" for kind in KINDS)
    schema = f"doc_id long, {counted}, base_sha256 string, spans string, n_added long"
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(find, schema)
