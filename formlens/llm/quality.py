"""Quality scores of documents by a factorisation machine over words, structure and metadata."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlens.functions.process import per_process
from formlens.llm.common import bounded_batches, shipped, text_slices
from formlens.llm.vocabularies import Memory, latin_pieces, text_bytes

BUCKETS = 1 << 15
RANK = 8
SAMPLE_ROWS = 6_000
EPOCHS = 6
SLICE_ROWS = 2_000

# Kinds of bytes that the structure statistics count.
UPPER, LOWER, DIGIT, SIGN, BLANK, LINE, HIGH = range(7)
KINDS = np.full(256, SIGN, dtype=np.int64)
KINDS[[*range(9), *range(11, 33), 9]] = BLANK
KINDS[ord("\n")] = LINE
KINDS[ord("0") : ord("9") + 1] = DIGIT
KINDS[ord("A") : ord("Z") + 1] = UPPER
KINDS[ord("a") : ord("z") + 1] = LOWER
KINDS[128:] = HIGH
STRUCTURE = 14


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: CRC-32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Features:
    """Sparse rows: row ``i`` has ``columns[bounds[i]:bounds[i + 1]]`` with ``values``; and dense statistics."""

    bounds: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    dense: np.ndarray


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def features(texts: pa.Array, n_chars: np.ndarray) -> Features:
    """Hashed words with damped counts of unit length, and statistics of structure and metadata."""
    n = len(texts)
    buckets = per_process("quality buckets", lambda: Memory(_bucket, 200_000))
    pieces, ends = latin_pieces(texts)
    coded = pieces.dictionary_encode()
    known = np.array([buckets[word] for word in coded.dictionary.to_pylist()], dtype=np.int64)
    places = known[coded.indices.to_numpy()] if len(pieces) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(ends, prepend=0)
    rows = np.repeat(np.arange(n), sizes)
    cells, counts = np.unique(rows * BUCKETS + places, return_counts=True)
    rows, columns = cells // BUCKETS, cells % BUCKETS
    values = 1 + np.log(counts)
    lengths = np.sqrt(np.bincount(rows, values**2, minlength=n))
    values /= lengths[rows]
    bounds = np.searchsorted(rows, np.arange(n + 1))

    edges, data = text_bytes(texts)
    owner = np.repeat(np.arange(n), np.diff(edges))
    kinds = KINDS[data]
    counted = np.bincount(owner * 8 + kinds, minlength=8 * n).reshape(n, 8).astype(np.float64)
    same = (data[1:] == data[:-1]) & (kinds[1:] == SIGN)
    doubled = np.bincount(owner[1:][same], minlength=n)
    total, words = np.maximum(counted.sum(axis=1), 1), np.maximum(sizes, 1)
    letters = np.maximum(counted[:, UPPER] + counted[:, LOWER] + counted[:, HIGH], 1)
    top = np.zeros(n)
    np.maximum.at(top, rows, counts)
    missing = np.isnan(n_chars)
    dense = np.column_stack(
        [
            np.log1p(counted.sum(axis=1)),
            np.log1p(sizes),
            letters / words,
            counted[:, UPPER] / letters,
            counted[:, DIGIT] / total,
            counted[:, SIGN] / total,
            doubled / total,
            counted[:, BLANK] / total,
            np.log1p(counted[:, LINE]),
            words / (1 + counted[:, LINE]) / 100,
            np.diff(bounds) / words,
            top / words,
            np.where(missing, 0, np.log1p(np.where(missing, 0, np.maximum(n_chars, 0)))),
            missing,
        ]
    )
    return Features(bounds, columns, values, dense)


class FactorisationMachine:
    """A linear model with pairwise interactions of low rank between all inputs."""

    def __init__(self, seed: int = 11):
        draw = np.random.default_rng(seed)
        n = BUCKETS + STRUCTURE
        self.bias, self.weights = 0.0, np.zeros(n)
        self.factors = draw.normal(0, 0.02, (n, RANK))
        self.middle, self.spread = np.zeros(STRUCTURE), np.ones(STRUCTURE)

    def inputs(self, data: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words and standardised statistics as one sparse matrix: bounds, columns, values."""
        dense = np.clip((data.dense - self.middle) / self.spread, -4, 4) / 2
        n, sizes = len(dense), np.diff(data.bounds)
        bounds = data.bounds + STRUCTURE * np.arange(n + 1)
        columns, values = np.empty(bounds[-1], dtype=np.int64), np.empty(bounds[-1])
        words = np.arange(data.bounds[-1]) + STRUCTURE * (1 + np.repeat(np.arange(n), sizes))
        columns[words], values[words] = data.columns, data.values
        statistics = bounds[:-1, None] + np.arange(STRUCTURE)
        columns[statistics], values[statistics] = BUCKETS + np.arange(STRUCTURE), dense
        return bounds, columns, values

    def forward(self, bounds: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores and the sums of factors: half of (square of the sum - sum of the squares) is all pairs."""
        if len(bounds) == 1:
            return np.zeros(0), np.zeros((0, RANK))
        scaled = self.factors[columns] * values[:, None]
        sums = np.add.reduceat(scaled, bounds[:-1])
        squares = np.add.reduceat((scaled**2).sum(axis=1), bounds[:-1])
        linear = np.add.reduceat(self.weights[columns] * values, bounds[:-1])
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def fit(self, data: Features, labels: np.ndarray, epochs: int, seed: int = 12) -> None:
        """Adaptive gradient steps on the logistic loss with weight decay."""
        self.middle, self.spread = data.dense.mean(axis=0), data.dense.std(axis=0) + 1e-6
        share = (labels.sum() + 1) / (len(labels) + 2)
        self.bias = float(np.log(share / (1 - share)))
        if labels.min() == labels.max():
            return
        bounds, columns, values = self.inputs(data)
        draw, rate, decay = np.random.default_rng(seed), 0.05, 1e-5
        seen_weights, seen_factors = np.full(len(self.weights), 1e-6), np.full(self.factors.shape, 1e-6)
        for _ in range(epochs):
            order = draw.permutation(len(labels))
            for low in range(0, len(order), 64):
                chosen = order[low : low + 64]
                sizes = bounds[chosen + 1] - bounds[chosen]
                part = np.concatenate(([0], np.cumsum(sizes)))
                places = np.repeat(bounds[chosen] - part[:-1], sizes) + np.arange(part[-1])
                column, value = columns[places], values[places]
                raw, sums = self.forward(part, column, value)
                slope = (1 / (1 + np.exp(-raw)) - labels[chosen]) / len(chosen)
                self.bias -= rate * float(slope.sum())
                steps = np.repeat(slope, sizes) * value
                own = self.factors[column] * value[:, None]
                bent = steps[:, None] * (np.repeat(sums, sizes, axis=0) - own)
                met, back = np.unique(column, return_inverse=True)
                flat = np.bincount(back, steps, minlength=len(met)) + decay * self.weights[met]
                curved = np.column_stack([np.bincount(back, bent[:, k], minlength=len(met)) for k in range(RANK)])
                curved += decay * self.factors[met]
                seen_weights[met] += flat**2
                seen_factors[met] += curved**2
                self.weights[met] -= rate * flat / np.sqrt(seen_weights[met])
                self.factors[met] -= rate * curved / np.sqrt(seen_factors[met])

    def scores(self, data: Features) -> np.ndarray:
        raw, _ = self.forward(*self.inputs(data))
        return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))


def _inputs(docs: DataFrame) -> list[Column]:
    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), n_chars.alias("n_chars")]


def _batch_features(batch: pa.RecordBatch) -> Features:
    n_chars = batch.column("n_chars").to_numpy(zero_copy_only=False).astype(np.float64)
    return features(batch.column("text").cast(pa.string()), n_chars)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> FactorisationMachine:
    """A machine fitted on at most ``sample`` labelled documents that are not held out, chosen by hash."""
    bounded_batches(docs.sparkSession)
    rows = labels.selectExpr("CAST(doc_id AS LONG) AS labelled", "CAST(quality AS INT) AS quality")
    rows = rows.filter("labelled IS NOT NULL AND quality IN (0, 1)").filter(~held_out(F.col("labelled")))
    rows = rows.distinct().orderBy(F.xxhash64("labelled"), "labelled", "quality").limit(sample)
    chosen = docs.select(*_inputs(docs)).join(F.broadcast(rows), F.col("doc_id") == F.col("labelled"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = _batch_features(batch)
            sizes = data.bounds.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("quality"),
                    pa.ListArray.from_arrays(sizes, pa.array(data.columns.astype(np.int32))),
                    pa.ListArray.from_arrays(sizes, pa.array(data.values)),
                    pa.ListArray.from_arrays(
                        np.arange(len(data.dense) + 1, dtype=np.int32) * STRUCTURE, pa.array(data.dense.ravel())
                    ),
                ],
                names=["doc_id", "quality", "columns", "values", "dense"],
            )

    schema = "doc_id long, quality int, columns array<int>, values array<double>, dense array<double>"
    # One row per sampled id and label, also if a table repeats an id very often.
    row = F.struct("columns", "values", "dense")
    single = chosen.mapInArrow(extract, schema).groupBy("doc_id", "quality").agg(F.min(row).alias("row"))
    table = single.select("doc_id", "quality", "row.*").toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    machine = FactorisationMachine()
    if table.num_rows:
        sizes = np.array([len(row) for row in table["columns"]])
        flat = [table[name].combine_chunks().flatten().to_numpy() for name in ("columns", "values", "dense")]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        data = Features(bounds, flat[0].astype(np.int64), flat[1], flat[2].reshape(-1, STRUCTURE))
        machine.fit(data, table["quality"].to_numpy().astype(np.float64), epochs)
    return machine


def score_quality(docs: DataFrame, machine: FactorisationMachine) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document; ``score`` is the chance of label 1.

    Inputs are the whole text and, where the table has it, ``n_chars``; labels, languages, sources and
    ids are none. Null texts are empty and scored by their statistics; a null ``n_chars`` is an input of
    its own. Null ids are not held out. Every row is scored, repeated rows alike; an empty table gives
    no rows, and other columns are ignored. A machine trained without labels of both kinds gives every
    document the (smoothed) share of label 1.
    """
    bounded_batches(docs.sparkSession)
    shared = shipped(docs.sparkSession, machine, "quality")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in batches:
            for part in text_slices(batch, SLICE_ROWS):
                scores = pa.array(model.scores(_batch_features(part)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), scores], names=["doc_id", "score"])

    scored = docs.select(*_inputs(docs)).mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
