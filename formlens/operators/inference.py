"""Batch inference with a model that the user brings.

A model factory is called once per worker process; what it returns is called with a list of prompts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlens.functions.process import latest_of_process

Generate = Callable[[list[str]], list[str]]
Embed = Callable[[list[str]], list[list[list[float]]]]


SIZE = "_prompt_size"
TASK_BYTES = 128 << 20


def _balanced(prompts: DataFrame, prompt: str, size: Column | None, n_tasks: int | None) -> DataFrame:
    """Spread prompts by hash, then put prompts of like size side by side inside every task, with ``_prompt_size``.

    Without ``n_tasks`` they are spread over as many tasks as a shuffle has. ``n_tasks`` are too few for prompts of more
    than ``TASK_BYTES`` each: their bytes are counted first, and a task is added for every further ``TASK_BYTES``.
    """
    if not n_tasks:
        n_tasks = int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    elif not prompts.isStreaming:
        n_bytes = prompts.agg(F.sum(F.octet_length(prompt))).first()[0] or 0
        n_tasks = max(n_tasks, -(-n_bytes // TASK_BYTES))
    size = F.length(prompt) if size is None else size
    keyed = prompts.withColumn(SIZE, F.coalesce(size.cast("bigint"), F.lit(0)))
    return keyed.repartition(n_tasks, "example_id", "format_id").sortWithinPartitions(F.desc(SIZE))


def _in_batches(arriving: Iterator[pa.RecordBatch], batch_size: int, budget: int | None) -> Iterator[pa.RecordBatch]:
    """At most ``batch_size`` rows at a time, whose number times the largest size stays within ``budget``.

    Batches are filled across what Spark hands over. A row of more than the budget is a batch of its own.
    """
    held, n, largest = [], 0, 0
    for rows in arriving:
        start = 0
        for place, size in enumerate(rows.column(SIZE).to_pylist()):
            full = n == batch_size or (budget is not None and max(largest, size) * (n + 1) > budget)
            if n and full:
                yield pa.concat_batches([*held, rows.slice(start, place - start)])
                held, n, largest, start = [], 0, 0, place
            n, largest = n + 1, max(largest, size)
        held.append(rows.slice(start))
    if n:
        yield pa.concat_batches(held)


def _check_budget(budget: int | None) -> None:
    if budget is not None and budget < 1:
        raise ValueError("max_batch_tokens must be positive")


def _checked(answers: list, prompts: list[str]) -> list:
    if len(answers) != len(prompts):
        raise ValueError(f"the model gave {len(answers)} results for {len(prompts)} prompts")
    return answers


def batch_generate(
    prompts: DataFrame,
    make_model: Callable[[float], Generate],
    batch_size: int = 32,
    temperature: float = 0.0,
    prompt: str = "prompt",
    n_tasks: int | None = None,
    max_batch_tokens: int | None = None,
    size: Column | None = None,
    resources: ResourceProfile | None = None,
) -> DataFrame:
    """Add ``generation``: one text per prompt. ``make_model(temperature)`` builds the model; 0 is greedy.

    Prompts of like ``size`` (tokens, say; characters by default) share a batch. ``max_batch_tokens`` bounds
    a batch as the model sees it, every prompt padded to the largest; a larger prompt goes alone.
    ``n_tasks`` is the least number of tasks: no task gets much more than 128 MiB of prompts.
    ``resources`` asks for what a task needs, such as a GPU.
    """
    if temperature < 0:
        raise ValueError("temperature must not be negative")
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    _check_budget(max_batch_tokens)

    token, names = uuid.uuid4().hex, prompts.columns

    def run(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_batches(arriving, batch_size, max_batch_tokens):
            model = latest_of_process("model", token, lambda: make_model(temperature))
            texts = batch.column(prompt).to_pylist()
            answers = pa.array(_checked(model(texts), texts), type=pa.string())
            yield batch.select(names).append_column("generation", answers)

    fields = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in prompts.schema.fields)
    return _balanced(prompts, prompt, size, n_tasks).mapInArrow(run, f"{fields}, generation STRING", profile=resources)


def batch_embed(
    prompts: DataFrame,
    make_encoder: Callable[[], Embed],
    batch_size: int = 32,
    prompt: str = "prompt",
    n_tasks: int | None = None,
    max_batch_tokens: int | None = None,
    size: Column | None = None,
    resources: ResourceProfile | None = None,
) -> DataFrame:
    """The last token's vector of every layer: one row per prompt and layer. Batches as in ``batch_generate``."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    _check_budget(max_batch_tokens)

    token = uuid.uuid4().hex

    def run(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_batches(arriving, batch_size, max_batch_tokens):
            encoder = latest_of_process("encoder", token, make_encoder)
            texts = batch.column(prompt).to_pylist()
            layers = pa.array(_checked(encoder(texts), texts), type=pa.list_(pa.list_(pa.float32())))
            yield batch.select(["format_id", "example_id"]).append_column("layers", layers)

    needed = _balanced(prompts, prompt, size, n_tasks).select("format_id", "example_id", prompt, SIZE)
    schema = "format_id INT, example_id BIGINT, layers ARRAY<ARRAY<FLOAT>>"
    embedded = needed.mapInArrow(run, schema, profile=resources)
    return embedded.select("format_id", "example_id", F.posexplode("layers").alias("layer", "embedding"))
