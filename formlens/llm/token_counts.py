"""Token counts of documents from the counts of their distinct pre-tokens."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlens.llm.common import bounded_batches, sampled, stored, text_slices, texts_of
from formlens.llm.vocabularies import BYTE_PIECES, BYTE_VOCABULARY, ODD_SPACE, load, special_strings

SAMPLE_DOCUMENTS = 4_000
FREQUENT_PIECES = 200_000
RARE = "array<struct<piece: string, n: long>>"
RARE_TYPE = pa.list_(pa.struct([("piece", pa.string()), ("n", pa.int64())]))


def pre_tokens(text: str, tokenizer, special: list[str]) -> tuple[list[str], int]:
    """The pre-tokens of a text, and how many special strings it has besides."""
    parts, n_special = [text], 0
    for mark in special:
        if mark in text:
            parts = [part for whole in parts for part in whole.split(mark)]
    n_special = len(parts) - 1
    pieces: list[str] = []
    for part in parts:
        if part.isascii() or max(part) <= "\xff":
            if not any(space in part for space in ODD_SPACE):
                pieces += BYTE_PIECES.findall(part)
                continue
        # Beyond the first 256 code points the library itself says where to cut.
        spans = [span for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        pieces += [part[start:stop] for start, stop in spans]
    return pieces, n_special


def _distinct_pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(piece, n)``: every task's own counts, not yet added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(vocabulary)
        special = special_strings(tokenizer)
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in texts_of(batch):
                counts.update(pre_tokens(text, tokenizer, special)[0])
            yield pa.RecordBatch.from_pydict({"piece": list(counts), "n": list(counts.values())})

    return docs.select("text").mapInArrow(count, "piece string, n long")


def _frequent_pieces(docs: DataFrame, vocabulary: str, sample: int, limit: int) -> dict[str, int]:
    """The most frequent pre-tokens of about ``sample`` documents with their numbers of tokens.

    Only how rows travel depends on it, never a result: these pre-tokens are looked up in the tasks.
    """
    counts = _distinct_pieces(sampled(docs, sample, "doc_id", "text"), vocabulary).groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = [row.piece for row in counts.orderBy(F.desc("n"), "piece").limit(limit).select("piece").toLocalIterator()]
    tokenizer = load(vocabulary)
    found: dict[str, int] = {}
    for start in range(0, len(pieces), 10_000):
        part = pieces[start : start + 10_000]
        found.update(zip(part, map(len, tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
    return found


def piece_counts(pieces: DataFrame, vocabulary: str) -> DataFrame:
    """``(piece, n_tokens)``: the tokens of every distinct pre-token, each counted once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(vocabulary)
        for batch in batches:
            encoded = tokenizer.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
            counts = pa.array([len(ids) for ids in encoded], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=["piece", "n_tokens"])

    return pieces.select("piece").distinct().mapInArrow(count, "piece string, n_tokens long")


def count_tokens(
    docs: DataFrame,
    vocabulary: str = BYTE_VOCABULARY,
    limit: int = 1024,
    sample: int = SAMPLE_DOCUMENTS,
    frequent: int = FREQUENT_PIECES,
) -> DataFrame:
    """Bytes and tokens of every document ``(doc_id, text)``, and whether it has over ``limit`` tokens.

    Texts are cut into pre-tokens once and counted per document. The ``frequent`` commonest
    pre-tokens (at most, found in about ``sample`` documents) make up most of any text and would be hot
    keys; they travel as a table of bounded size. All others go, once per document with their
    frequency, to a join with the counts of the distinct pre-tokens. No ids are kept.

    Null texts are empty: no bytes, no tokens. Rows are counted one by one, so null and repeated ids
    and repeated rows each get their own result. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = spark.sparkContext.broadcast(_frequent_pieces(docs, vocabulary, sample, frequent))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(vocabulary)
        special = special_strings(tokenizer)
        tokens_of = known.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in text_slices(batch, 2000):
                keys, sizes, counted, rare = [], [], [], []
                for text in texts_of(part):
                    pieces, total = pre_tokens(text, tokenizer, special)
                    left = []
                    for piece, n in Counter(pieces).items():
                        tokens = tokens_of.get(piece)
                        if tokens is None:
                            left.append((piece, n))
                        else:
                            total += n * tokens
                    keys.append(row)
                    row += 1
                    sizes.append(len(text.encode()))
                    counted.append(total)
                    rare.append([{"piece": piece, "n": n} for piece, n in left])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(counted, pa.int64()),
                        pa.array(rare, RARE_TYPE),
                    ],
                    names=["row", "doc_id", "n_bytes", "counted", "rare"],
                )

    schema = f"row long, doc_id long, n_bytes long, counted long, rare {RARE}"
    texts = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text")
    table = stored(texts.mapInArrow(split, schema), "token-counts")
    rare = table.select("row", F.explode("rare").alias("each")).select("row", "each.piece", "each.n")
    joined = rare.join(piece_counts(rare, vocabulary), "piece")
    sums = joined.groupBy("row").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"))
    total = F.col("counted") + F.coalesce("tokens", F.lit(0))
    return (
        table.drop("rare")
        .join(sums, "row", "left")
        .select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
    )
