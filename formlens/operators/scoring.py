"""Generations to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlens.fixed_values import ANSWER_SEPARATOR, END_TAG, STOP_STRINGS
from formlens.functions.text import before_end_tag, closing_run, last_number, last_run, normalized, until_stop, with_canonical_number
from formlens.operators.examples import reference_answers

FORMAT_KEYS = ["experiment", "format_id"]


def cut_at_end_tag(generations: DataFrame, tag: str = END_TAG) -> DataFrame:
    return generations.withColumn("generation", before_end_tag(F.col("generation"), tag))


def truncate_at_stop(
    generations: DataFrame, stops: list[str] = STOP_STRINGS, keep_stop: bool = False
) -> DataFrame:
    return generations.withColumn("generation", until_stop(F.col("generation"), stops, keep_stop))


def extract_answers(generations: DataFrame) -> DataFrame:
    """Replace the generation by ``extracted``, its last number before the end tag or an empty string.

    The whole text is searched only where the number does not lie in its closing
    characters. Steps are columns of their own so that none is evaluated twice, and no
    long text goes into a shuffle.
    """
    cut = generations.withColumn("_text", before_end_tag(F.col("generation")))
    closing = cut.withColumn("_closing", closing_run(F.col("_text")))
    run = F.when(F.col("_closing") != "", F.col("_closing")).otherwise(last_run(F.col("_text")))
    runs = closing.withColumn("_run", run)
    return runs.withColumn("extracted", last_number(F.col("_run"))).drop("generation", "_text", "_closing", "_run")


def normalize_answers(extracted: DataFrame) -> DataFrame:
    return extracted.withColumn("prediction", normalized(F.col("extracted"))).drop("extracted")


def predictions(generations: DataFrame, strict_numeric: bool = False) -> DataFrame:
    """Every generation's ``prediction``: by default its last run of digits, normalised as references are.

    With ``strict_numeric`` it is the value of the last number, sign, thousands and per cent included, in its
    canonical spelling, so that ``-5`` differs from ``5`` and ``1,000.0`` equals ``1000``.
    """
    if strict_numeric:
        return with_canonical_number(generations, before_end_tag(F.col("generation")), "prediction").drop("generation")
    return normalize_answers(extract_answers(generations))


def score_counts(generations: DataFrame, references: DataFrame, strict_numeric: bool = False) -> DataFrame:
    """Per experiment and format: the accuracy over the generations that ``references`` knows, and what is amiss.

    ``n_scored`` generations have a reference, ``n_unmatched`` have none, ``n_duplicates`` repeat an
    example of their format, and ``n_missing`` references are without a generation. Every format
    stays, one without any match with a null accuracy. Both sides of the join are short, and rows
    of one example are counted where the join has put them.
    """
    return predicted_counts(predictions(generations, strict_numeric), references)


def predicted_counts(predicted: DataFrame, references: DataFrame) -> DataFrame:
    """``score_counts`` of generations whose ``predictions`` are there already."""
    known = references.select("example_id", "reference", F.lit(True).alias("_known"))
    joined = predicted.join(known, "example_id", "left")
    correct = F.when(F.col("_known"), F.col("prediction").eqNullSafe(F.col("reference")).cast("double"))
    by_example = joined.groupBy(*FORMAT_KEYS, "example_id").agg(
        F.count("*").alias("n"), F.sum(correct).alias("correct"), F.first("_known").alias("known")
    )
    n_known, matched = references.agg(F.count("*").alias("n")).scalar(), F.col("known").isNotNull()
    return by_example.groupBy(*FORMAT_KEYS).agg(
        (F.sum("correct") / F.sum(F.when(matched, F.col("n")))).alias("accuracy"),
        F.coalesce(F.sum(F.when(matched, F.col("n"))), F.lit(0)).alias("n_scored"),
        F.coalesce(F.sum(F.when(~matched, F.col("n"))), F.lit(0)).alias("n_unmatched"),
        F.coalesce(F.sum(F.when(matched, F.col("n") - 1)), F.lit(0)).alias("n_duplicates"),
        (n_known - F.count_if(matched)).alias("n_missing"),
    )


def align_generations(generations: DataFrame, examples: DataFrame, separator: str = ANSWER_SEPARATOR) -> DataFrame:
    """Prediction and reference side by side. Both sides are cut down to short answers first."""
    return predictions(generations).join(reference_answers(examples, separator), "example_id")


def check_counts(generations: DataFrame, examples: DataFrame) -> DataFrame:
    """Rows per format against the number of examples: ``complete`` says whether they agree."""
    expected = examples.agg(F.count("*").alias("expected")).scalar()
    counts = generations.groupBy(*FORMAT_KEYS).agg(F.count("*").alias("n_generations"))
    return counts.select("*", expected.alias("n_examples"), (F.col("n_generations") == expected).alias("complete"))


def format_accuracy(
    generations: DataFrame, examples: DataFrame, separator: str = ANSWER_SEPARATOR, strict: bool = True, strict_numeric: bool = False
) -> DataFrame:
    """Share of exact matches per experiment and format; of equal numbers with ``strict_numeric``.

    When ``strict``, a generation without a reference, an example scored twice and an example
    without a generation are errors, as the accuracies could not be compared. Otherwise every
    format stays as ``score_counts`` has it.
    """
    return predicted_accuracy(predictions(generations, strict_numeric), examples, separator, strict, strict_numeric)


def predicted_accuracy(
    predicted: DataFrame, examples: DataFrame, separator: str = ANSWER_SEPARATOR, strict: bool = True, strict_numeric: bool = False
) -> DataFrame:
    """``format_accuracy`` of generations whose ``predictions`` are there already."""
    references = reference_answers(examples, separator, strict_numeric=strict_numeric)
    counts = predicted_counts(predicted, references)
    if not strict:
        return counts.select(*FORMAT_KEYS, "accuracy", "n_scored")
    n_unanswered = examples.filter("answer IS NULL").agg(F.count("*").alias("n")).scalar()
    n_examples = examples.agg(F.count("*").alias("n")).scalar()
    amiss = [F.col("n_unmatched"), F.col("n_duplicates"), F.col("n_missing") + n_unanswered]
    message = F.concat(
        F.col("experiment"), F.lit(", format "), F.col("format_id"), F.lit(": scored generations "), F.col("n_scored"),
        F.lit(", examples "), n_examples, F.lit(", without a reference "), amiss[0], F.lit(", repeated "), amiss[1], F.lit(", missing "), amiss[2],
    )
    fine = (amiss[0] == 0) & (amiss[1] == 0) & (amiss[2] == 0)
    checked = F.when(fine, F.col("accuracy")).otherwise(F.raise_error(message))
    return counts.select(*FORMAT_KEYS, checked.alias("accuracy"), "n_scored")


def accuracy_of(scored: DataFrame) -> DataFrame:
    return scored.groupBy(*FORMAT_KEYS).agg(
        F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count("*").alias("n_scored")
    )
