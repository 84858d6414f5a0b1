"""Choosing and parsing question/answer examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlens.fixed_values import ANSWER_SEPARATOR, RESPONSE_TAG
from formlens.functions.text import answer_parts, normalized, with_canonical_number
from formlens.operators.sampling import first_rows, hash_ranked, row_ordinals


def _with_parts(examples: DataFrame, separator: str) -> DataFrame:
    """Add ``_parts``, and ``_fits``: no answer at all, or exactly two parts."""
    if "answer" not in examples.columns:
        examples = examples.withColumn("answer", F.lit(None).cast("string"))
    parts = examples.withColumn("_parts", answer_parts(F.col("answer"), separator))
    return parts.withColumn("_fits", F.col("answer").isNull() | F.col("_parts.once"))


def parse_examples(examples: DataFrame, separator: str = ANSWER_SEPARATOR, strict: bool = True) -> DataFrame:
    """Split ``answer`` into ``reasoning`` and ``answer``; a missing answer gives nulls.

    An answer that does not have exactly two parts is an error. When not ``strict`` such
    rows are left out here and found by ``rejected_examples``.
    """
    split = _with_parts(examples, separator)
    if not strict:
        split = split.filter("_fits")
    message = F.concat(F.lit("not exactly two answer parts in example "), F.col("example_id").cast("string"))
    misfit = F.raise_error(message)

    def part(name: str):
        # Each column checks for itself: a query may read only one of them.
        return F.when(F.col("_fits"), F.col(f"_parts.{name}")).otherwise(misfit).alias(name)

    others = [name for name in examples.columns if name not in ("answer", "reasoning")]
    return split.select(*others, part("reasoning"), part("answer"))


def rejected_examples(examples: DataFrame, separator: str = ANSWER_SEPARATOR) -> DataFrame:
    """Examples whose answer does not have exactly two parts."""
    return _with_parts(examples, separator).filter(~F.col("_fits")).select(*examples.columns)


def reference_answers(
    examples: DataFrame, separator: str = ANSWER_SEPARATOR, strict: bool = True, strict_numeric: bool = False
) -> DataFrame:
    """The normalised final answer of every example that has one; with ``strict_numeric`` its number's canonical spelling."""
    answered = examples.select("example_id", "answer").filter("answer IS NOT NULL")
    parsed = parse_examples(answered, separator, strict)
    if strict_numeric:
        return with_canonical_number(parsed, F.col("answer"), "reference").select("example_id", "reference")
    return parsed.select("example_id", normalized(F.col("answer")).alias("reference"))


def head_examples(examples: DataFrame, n: int) -> DataFrame:
    """The first ``n`` examples by id, or all when there are fewer."""
    return first_rows(examples, n, F.lit(0), "example_id")


def order_by_question_length(examples: DataFrame) -> DataFrame:
    """Add ``ordinal``: longest question first, equal lengths by id."""
    return row_ordinals(examples, F.length("question"), "example_id")


def longest_examples(examples: DataFrame, n: int) -> DataFrame:
    """The ``n`` examples with the most question and answer characters together."""
    size = F.coalesce(F.length("question"), F.lit(0)) + F.coalesce(F.length("answer"), F.lit(0))
    return first_rows(examples, n, size, "example_id")


def select_few_shot(train: DataFrame, seed: int, subset: int = 100) -> DataFrame:
    """The shortest and then the longest answer in a random subset of the answered examples; the earlier draw wins a tie."""
    drawn = hash_ranked(train.filter("answer IS NOT NULL"), seed, "example_id", subset)
    row = F.struct("example_id", "question", "answer")
    size = F.length("answer")
    ends = drawn.agg(
        F.min_by(row, F.struct(size, F.col("sample_rank"))).alias("shortest"),
        F.min_by(row, F.struct(-size, F.col("sample_rank"))).alias("longest"),
    )
    shots = ends.select(F.posexplode(F.array("shortest", "longest")).alias("shot_rank", "shot"))
    return shots.select("shot_rank", "shot.*")


def split_disjoint(rows: DataFrame, n: int, seed: int, key: str = "example_id", strict: bool = True) -> DataFrame:
    """``2n`` rows without replacement; ``half`` is 0 or 1. Fewer than ``2n`` rows is an error."""
    drawn = hash_ranked(rows, seed, key, 2 * n)
    half = F.when(F.col("sample_rank") < n, 0).otherwise(1)
    if strict:
        enough = rows.agg((F.count("*") >= 2 * n).alias("enough")).scalar()
        half = F.when(enough, half).otherwise(F.raise_error(F.lit(f"fewer than {2 * n} rows to split")))
    return drawn.withColumn("half", half)


def response_segments(training: DataFrame, response_tag: str = RESPONSE_TAG) -> DataFrame:
    """Cut ``text`` after the response tag: only ``response`` counts for the loss.

    Without the tag there is nothing to learn from: ``has_response`` is false.
    """
    at = F.instr("text", response_tag)
    cut = at + len(response_tag)
    whole = F.lit(2**31 - 1)
    return training.select(
        "*",
        (at > 0).alias("has_response"),
        F.when(at > 0, F.substring(F.col("text"), F.lit(1), cut - 1)).otherwise(F.col("text")).alias("instruction"),
        F.when(at > 0, F.substring(F.col("text"), cut, whole)).otherwise("").alias("response"),
    )
