"""Column functions over prompt and answer text. All of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formlens.fixed_values import ANSWER_SEPARATOR, ANSWER_TRIM, END_TAG, NUMBER_PATTERN

CLOSING_CHARS = 256


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of cased letters, lower-case the others.

    ``initcap`` only looks at blanks, so it would leave ``it's`` as ``It's`` and not ``It'S``.
    """
    runs = F.regexp_extract_all(text, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda run: F.concat(F.upper(F.left(run, F.lit(1))), F.lower(F.substring(run, 2, 2**31 - 1)))),
        "",
    )


def transformed(transform: Column, descriptor: Column) -> Column:
    """Apply the named transform; an unknown name is an error."""
    return (
        F.when(transform == "identity", descriptor)
        .when(transform == "title", title_case(descriptor))
        .when(transform == "upper", F.upper(descriptor))
        .when(transform == "lower", F.lower(descriptor))
        .otherwise(F.raise_error(F.concat(F.lit("unknown descriptor transform: "), transform)))
    )


def is_present(text: Column) -> Column:
    """Null and empty sections are both absent."""
    return F.coalesce(text, F.lit("")) != ""


def rendered(question: Column, reasoning: Column, answer: Column, spec: Column, add_tags: bool) -> Column:
    """One example in one format. ``spec`` is a struct with the columns of ``label_descriptors``."""

    def tag(name: str) -> Column:
        return spec[name] if add_tags else F.lit("")

    head = F.concat(tag("instruction_tag"), spec["first_label"], spec["separator"], question, spec["space"])
    middle = F.concat(tag("response_tag"), spec["second_label"], spec["separator"], reasoning, spec["space"])
    tail = F.concat(spec["third_label"], spec["separator"], answer, tag("end_tag"))
    return F.concat(
        head,
        F.when(is_present(reasoning), middle).otherwise(""),
        F.when(is_present(answer), tail).otherwise(""),
    )


def from_place(text: Column, place: Column) -> Column:
    return F.substring(text, place, F.lit(2**31 - 1))


def answer_parts(answer: Column, separator: str = ANSWER_SEPARATOR) -> Column:
    """``reasoning`` and ``answer`` around a literal separator, and whether it occurs exactly once.

    Blanks are kept. Plain searches, as the text before the separator can be long.
    """
    at = F.instr(answer, separator)
    rest = from_place(answer, at + len(separator))
    once = (at > 0) & (F.instr(rest, separator) == 0)
    return F.struct(F.substring(answer, F.lit(1), at - 1).alias("reasoning"), rest.alias("answer"), once.alias("once"))


def before_end_tag(generation: Column, tag: str = END_TAG) -> Column:
    return F.substring_index(generation, tag, 1)


# A number never crosses a character other than a digit, a dot or a dash. So the last number
# of a text lies in its last run of such characters that ends in a digit. Runs are looked
# for from the back, and so are spelled backwards.


def closing_run(text: Column) -> Column:
    """The last run if it lies within the closing characters of the text, otherwise an empty string."""
    return F.regexp_extract(F.reverse(F.right(text, F.lit(CLOSING_CHARS))), r"([0-9][-.0-9]*)[^-.0-9]", 1)


def last_run(text: Column) -> Column:
    return F.regexp_extract(F.reverse(text), r"[0-9][-.0-9]*", 0)


def last_number(run: Column) -> Column:
    """The last number in a run, or an empty string; null for null."""
    numbers = F.regexp_extract_all(F.reverse(run), F.lit(NUMBER_PATTERN), F.lit(0))
    return F.coalesce(F.try_element_at(numbers, F.lit(-1)), F.when(run.isNotNull(), ""))


def normalized(answer: Column) -> Column:
    return F.lower(F.btrim(answer, F.lit(ANSWER_TRIM)))


# Digits with or without commas between groups of three, a fraction, a sign in front and a per cent sign behind.
WRITTEN_NUMBER = r"[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+(?![0-9])|[0-9]+)(?:\.[0-9]+)?%?"


# It never crosses a character other than these, so the last number of a text lies in its last run of them with a
# digit, up to that digit and a per cent sign right behind it. Runs are looked for from the back here, too.
WRITTEN_RUN = r"%?[0-9][-+,.%0-9]*+"


def closing_written_run(text: Column) -> Column:
    """That run if it lies within the closing characters of the text, otherwise an empty string."""
    return F.regexp_extract(F.reverse(F.right(text, F.lit(CLOSING_CHARS))), f"({WRITTEN_RUN})[^-+,.%0-9]", 1)


def last_written_run(text: Column) -> Column:
    return F.regexp_extract(F.reverse(text), WRITTEN_RUN, 0)


def written_number(run: Column) -> Column:
    """The number at the end of a run, with sign, commas and per cent sign, or an empty string; null for null."""
    numbers = F.regexp_extract_all(F.reverse(run), F.lit(WRITTEN_NUMBER), F.lit(0))
    return F.coalesce(F.try_element_at(numbers, F.lit(-1)), F.when(run.isNotNull(), ""))


def with_canonical_number(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the last number of ``text`` in the one spelling of its value: ``+1,050.50`` is ``1050.5``, ``-0`` is ``0``, ``5%`` is ``0.05``.

    Digits are moved as text, so that numbers of any length stay exact. Without a number it is the empty string.
    Long texts are searched once, and only where the number does not lie in their closing characters; steps are
    columns of their own so that none is evaluated twice.
    """
    steps = rows.withColumn("_text", text).withColumn("_closing", closing_written_run(F.col("_text")))
    run = F.when(F.col("_closing") != "", F.col("_closing")).otherwise(last_written_run(F.col("_text")))
    steps = steps.withColumn("_run", run).drop("_text", "_closing")
    steps = steps.withColumn("_written", written_number(F.col("_run"))).drop("_run")
    steps = steps.withColumn("_plain", F.regexp_replace("_written", r"[+,%-]", ""))
    steps = steps.withColumn("_whole", F.substring_index("_plain", ".", 1)).withColumn("_part", F.regexp_extract("_plain", r"\.([0-9]+)", 1))
    percent, padded = F.endswith("_written", F.lit("%")), F.concat(F.lit("00"), F.col("_whole"))
    # Per cent moves the point by two digits.
    part = F.when(percent, F.concat(F.right(padded, F.lit(2)), F.col("_part"))).otherwise(F.col("_part"))
    whole = F.when(percent, F.substring(padded, F.lit(1), F.length(padded) - 2)).otherwise(F.col("_whole"))
    steps = steps.withColumn("_part", F.rtrim(part, F.lit("0"))).withColumn("_whole", F.ltrim(whole, F.lit("0")))
    fraction = F.when(F.col("_part") == "", "").otherwise(F.concat(F.lit("."), F.col("_part")))
    steps = steps.withColumn("_value", F.concat(F.when(F.col("_whole") == "", "0").otherwise(F.col("_whole")), fraction))
    negative = F.startswith("_written", F.lit("-")) & (F.col("_value") != "0")
    signed = F.when(negative, F.concat(F.lit("-"), F.col("_value"))).otherwise(F.col("_value"))
    found = F.when(F.col("_written") == "", "").otherwise(signed)
    return steps.withColumn(name, found).drop("_written", "_plain", "_whole", "_part", "_value")


def until_stop(generation: Column, stops: list[str], keep_stop: bool = False) -> Column:
    """The text before the earliest stop string, with that string when ``keep_stop``.

    Of stops that begin at the same place the first in the list is kept. Every stop is a
    plain search, which is many times faster over long texts than one pattern of alternatives.
    """
    if not stops or "" in stops:
        raise ValueError("stop strings must be non-empty")
    places = [F.instr(generation, stop) for stop in stops]
    earliest = F.array_min(F.filter(F.array(*places), lambda place: place > 0))
    kept = F.substring(generation, F.lit(1), F.coalesce(earliest - 1, F.lit(2**31 - 1)))
    if keep_stop:
        found = [F.when(place == earliest, stop) for place, stop in zip(places, stops)]
        kept = F.concat(kept, F.coalesce(*found, F.lit("")))
    return kept
