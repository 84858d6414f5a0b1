"""The three studies, from stored tables to results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from formlens.operators.differences import contrast_diffs, format_pair_diffs, sampled_format_pairs
from formlens.operators.directions import principal_directions
from formlens.operators.examples import response_segments, select_few_shot
from formlens.operators.formats import (
    available_formats,
    format_grid,
    leaked_formats,
    sample_formats,
    split_formats,
    with_descriptors,
)
from formlens.operators.prompts import augment_examples, few_shot_prompts, tagged_prompts
from formlens.operators.report import accuracy_spread, accuracy_summary, best_worst_format
from formlens.operators.scoring import format_accuracy, predicted_accuracy, predictions
from formlens.operators.states import select_layer
from formlens.sources.examples import read_sorted_examples
from formlens.sources.generations import read_generations
from formlens.sources.tables import stored


def study_formats(spark: SparkSession, n: int, seed: int) -> DataFrame:
    return with_descriptors(sample_formats(format_grid(spark), n, seed))


def evaluation_prompts(
    tests: DataFrame, train: DataFrame | None, formats: DataFrame, done: DataFrame | None, seed: int, subset: int = 100
) -> DataFrame:
    """Prompts still to be answered: with worked examples from ``train``, or tagged when there is none.

    ``done`` holds outputs of this experiment: their formats are dropped before examples are
    multiplied by formats.
    """
    if done is not None:
        _, formats = available_formats(formats, done)
    if train is None:
        return tagged_prompts(tests, formats)
    return few_shot_prompts(tests, select_few_shot(train, seed, subset), formats)


@dataclass
class Evaluation:
    accuracy: DataFrame
    summary: DataFrame
    spread: DataFrame
    extremes: DataFrame


def evaluate(generations: DataFrame, examples: DataFrame, strict: bool = True) -> Evaluation:
    return _evaluation(format_accuracy(generations, examples, strict=strict))


def _evaluation(accuracy: DataFrame) -> Evaluation:
    # A row per format, stored, so that the generations are scored once for all four tables.
    accuracy, keys = stored(accuracy, "accuracy"), ["experiment"]
    return Evaluation(
        accuracy, accuracy_summary(accuracy, keys), accuracy_spread(accuracy, keys), best_worst_format(accuracy, keys)
    )


def evaluate_folder(spark: SparkSession, examples_path: str, arrays_path: str, strict: bool = True) -> Evaluation:
    """An experiment folder of other tools to results: sorted examples, and arrays of generations in their order."""
    examples = read_sorted_examples(spark, examples_path)
    # Short answers before the join: no text goes into a shuffle, however many examples there are.
    answers = predictions(read_generations(spark, arrays_path, with_experiment=True))
    answers = answers.join(examples.select("ordinal", "example_id"), "ordinal", "left").drop("ordinal")
    return _evaluation(predicted_accuracy(answers, examples.drop("ordinal"), strict=strict))


def format_directions(
    states: DataFrame,
    layer: int,
    k: int,
    seed: int,
    n_blocks: int = 128,
    block_size: int = 32,
    target_format: int | None = None,
) -> DataFrame:
    """Principal directions of format differences: random pairs, or one format against the others."""
    chosen = select_layer(states, layer)
    if target_format is not None:
        return principal_directions(contrast_diffs(chosen, target_format), k)
    pairs = sampled_format_pairs(chosen, n_blocks, block_size, seed)
    return principal_directions(format_pair_diffs(chosen, pairs), k)


def training_set(
    train: DataFrame, n: int, per_example: int, seed: int, n_formats: int = 960, n_test: int = 10, exclude_leaks: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Training texts in sampled formats, cut for the loss, and the formats held out for testing.

    With ``exclude_leaks`` no training format renders like a test format.
    """
    test_formats, train_formats = split_formats(study_formats(train.sparkSession, n_formats, seed), n_test)
    if exclude_leaks:
        train_formats = train_formats.join(leaked_formats(test_formats, train_formats).select("format_id"), "format_id", "left_anti")
    return response_segments(augment_examples(train, train_formats, n, per_example, seed)), test_formats
