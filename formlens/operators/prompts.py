"""Examples times formats: prompts and training texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlens.fixed_values import ANSWER_SEPARATOR
from formlens.functions.text import rendered
from formlens.operators.dimensions import MAX_BYTES, as_array, for_each_format
from formlens.operators.examples import longest_examples, parse_examples
from formlens.operators.formats import label_descriptors
from formlens.operators.sampling import distinct_positions, hash_key


def _nothing() -> Column:
    return F.lit(None).cast("string")


def render_prompts(parsed: DataFrame, formats: DataFrame, add_tags: bool = False) -> DataFrame:
    """Every parsed example in every format."""
    text = rendered(F.col("question"), F.col("reasoning"), F.col("answer"), F.col("spec"), add_tags)
    return for_each_format(parsed, label_descriptors(formats)).select(
        "example_id", F.col("spec.format_id").alias("format_id"), text.alias("prompt")
    )


def tagged_prompts(tests: DataFrame, formats: DataFrame) -> DataFrame:
    """The question alone, with tags."""
    text = rendered(F.col("question"), _nothing(), _nothing(), F.col("spec"), True)
    return for_each_format(tests.select("example_id", "question"), label_descriptors(formats)).select(
        "example_id", F.col("spec.format_id").alias("format_id"), text.alias("prompt")
    )


def few_shot_prompts(
    tests: DataFrame, shots: DataFrame, formats: DataFrame, separator: str = ANSWER_SEPARATOR
) -> DataFrame:
    """Worked examples in ``shot_rank`` order, then the question; a blank line between all of them.

    What every task holds is the formats and the worked examples, not their product: the
    latter are rendered in the row whose prompt contains them anyway.
    """
    missing = F.raise_error(F.lit("every worked example must have an answer"))
    answered = shots.withColumn("answer", F.when(F.col("answer").isNull(), missing).otherwise(F.col("answer")))
    columns = ["shot_rank", "question", "reasoning", "answer"]
    shot_list = as_array(parse_examples(answered, separator).select(*columns), "shot_rank")
    spec = F.col("spec")
    worked = F.transform(
        F.col("shots"), lambda shot: rendered(shot["question"], shot["reasoning"], shot["answer"], spec, False)
    )
    question = rendered(F.col("question"), _nothing(), _nothing(), spec, False)
    rows = for_each_format(tests.select("example_id", "question"), label_descriptors(formats))
    return rows.withColumn("shots", shot_list).select(
        "example_id",
        spec["format_id"].alias("format_id"),
        F.concat(F.array_join(worked, "\n\n"), F.lit("\n\n"), question).alias("prompt"),
    )


def augment_examples(
    train: DataFrame,
    formats: DataFrame,
    n: int,
    per_example: int,
    seed: int,
    separator: str = ANSWER_SEPARATOR,
) -> DataFrame:
    """The ``n`` longest examples, each in ``per_example`` distinct random formats, with tags.

    The formats of an example are picked inside its row, so the product of examples and
    formats is never shuffled.
    """
    parsed = parse_examples(longest_examples(train, n), separator)
    specs = as_array(label_descriptors(formats), "format_id")
    keyed = F.transform(
        F.col("specs"),
        lambda spec: F.struct(
            hash_key(seed, F.col("example_id"), spec["format_id"]).alias("hash"),
            spec["format_id"].alias("format_id"),
            spec.alias("spec"),
        ),
    )
    too_few = F.raise_error(F.lit(f"fewer than {per_example} formats to choose from"))
    chosen = F.when(F.size("specs") < per_example, too_few).otherwise(F.slice(F.array_sort(keyed), 1, per_example))
    rows = parsed.withColumn("specs", specs).select("*", F.explode(chosen).alias("pick")).select("*", "pick.spec")
    return _training_texts(rows)


def _training_texts(rows: DataFrame) -> DataFrame:
    text = rendered(F.col("question"), F.col("reasoning"), F.col("answer"), F.col("spec"), True)
    return rows.select("example_id", F.col("spec.format_id").alias("format_id"), text.alias("text"))


def augment_with_drawn_formats(
    train: DataFrame,
    formats: DataFrame,
    n: int,
    per_example: int,
    seed: int,
    separator: str = ANSWER_SEPARATOR,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """As ``augment_examples``, but formats are drawn by position: the work for an example does not grow with the catalogue."""
    parsed = parse_examples(longest_examples(train, n), separator)
    rows = parsed.withColumn("specs", as_array(label_descriptors(formats), "format_id", max_bytes))
    too_few = F.raise_error(F.lit(f"fewer than {per_example} formats to choose from"))
    drawn = distinct_positions(seed, F.col("example_id"), per_example, F.size("specs"))
    places = F.when(F.size("specs") < per_example, too_few).otherwise(drawn)
    rows = rows.select("*", F.explode(places).alias("place"))
    return _training_texts(rows.withColumn("spec", F.get("specs", F.col("place").cast("int"))))


def chat_messages(prompts: DataFrame, system: str | None = None, prompt: str = "prompt") -> DataFrame:
    """Every prompt as a list of role/content messages, after an optional system message.

    A table with a ``role`` column says who speaks (null: the user), and a row is one turn: turns of a
    conversation are not gathered into one row.
    """

    def message(role: Column | str, content: Column) -> Column:
        role = F.lit(role) if isinstance(role, str) else role
        return F.struct(role.alias("role"), content.alias("content"))

    role = F.coalesce(F.col("role").cast("string"), F.lit("user")) if "role" in prompts.columns else "user"
    messages = [message(role, F.col(prompt))]
    if system is not None:
        messages.insert(0, message("system", F.lit(system)))
    return prompts.withColumn("messages", F.array(*messages))
