"""From raw documents to packed training windows: stages, each over all that its predecessor kept.

All stages but the last return the columns of ``documents``; each result is written as Parquet and
read again as the next one's input. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens.llm import language
from formlens.llm.common import fresh_name, stored
from formlens.llm.decontamination import find_items
from formlens.llm.line_dedup import dedup_lines
from formlens.llm.packing import pack_documents
from formlens.llm.simhash import near_duplicates

MIN_LANGUAGE_SHARE = 0.5


def columns_of(docs: DataFrame) -> list[str]:
    return [f"`{name}`" for name in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least half of the words are of one language.

    Null texts and texts without letters go. If no document tells its language, nothing can be
    learnt, and every document with a letter stays.
    """
    model = language.train(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    labelled = language.label_languages(docs, model)
    predicted, score = labelled.columns[len(docs.columns)], labelled.columns[len(docs.columns) + 1]
    accepted = (F.col(predicted) != language.UNDETERMINED) & (F.col(score) >= MIN_LANGUAGE_SHARE)
    return labelled.filter(accepted).select(*columns_of(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that repeat earlier ones; those that lose all their lines go.

    ``n_chars`` follows a shortened text.
    """
    result = dedup_lines(docs)
    n_lines, n_deleted = (F.col(name) for name in result.columns[len(docs.columns) :])
    n_chars = F.when(n_deleted > 0, F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])
    kept = result.filter((n_deleted == 0) | (n_deleted < n_lines)).withColumn("n_chars", n_chars)
    return kept.select(*columns_of(docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates, that with the smallest id.

    Of different texts with that id the one of least hash stays; rows equal in id and text are one
    document. Documents without an id name no group and stay. Texts are dealt out once and not sorted.
    """
    first = near_duplicates(docs).filter("doc_id = component_id").select("doc_id").distinct()
    text = fresh_name(docs, "text_hash")
    keyed = docs.filter("doc_id IS NOT NULL").withColumn(text, F.coalesce(F.xxhash64("text"), F.lit(0)))
    least = keyed.groupBy("doc_id").agg(F.min(text).alias(text)).join(first, "doc_id", "left_semi")
    kept = keyed.join(least.hint("shuffle_hash"), ["doc_id", text], "left_semi")
    return kept.select(*columns_of(docs)).unionByName(docs.filter("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_items(docs, items)
    return found.filter(F.size(found.columns[-1]) == 0).select(*columns_of(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a window of 2,048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

# The language model, hashing by XXH64 and the tokenizer are beyond SQL; a brute-force version tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, with a table in the shared folder after each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}".replace(" ", "-"))
    return docs
