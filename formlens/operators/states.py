"""Tables of hidden states. Layer 0 is the output of the first block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE_KEYS = ["format_id", "example_id", "layer"]


def select_layer(
    states: DataFrame, layer: int | None = None, fraction: float | None = None, includes_input: bool = False
) -> DataFrame:
    """One layer, by number or as a fraction of the number of layers (rounded down).

    ``layer`` is a partition column of stored states, so other layers are not read.
    ``includes_input`` says that entry 0 of the table is the input embedding: it does not
    count as a layer, and numbers still mean entries of the table.
    """
    if (layer is None) == (fraction is None):
        raise ValueError("give either a layer or a fraction")
    if layer is not None:
        return states.filter(F.col("layer") == layer)
    n_layers = F.max("layer") + (0 if includes_input else 1)
    wanted = states.agg(F.floor(n_layers * fraction).cast("int").alias("wanted")).scalar()
    return states.filter(F.col("layer") == wanted)


def last_token_states(token_states: DataFrame) -> DataFrame:
    """The state at the last position of every sequence, for every layer.

    The last positions are found over the keys alone; vectors only meet the join.
    """
    last = token_states.groupBy(*STATE_KEYS).agg(F.max("position").alias("position"))
    return token_states.join(last, [*STATE_KEYS, "position"], "left_semi").select(*STATE_KEYS, "embedding")


def vector_quality(states: DataFrame) -> DataFrame:
    """Per format and layer: rows, shortest and longest vector, and whether a value is NaN or infinite."""

    def broken(x):
        number = x.cast("double")
        return F.isnan(number) | (F.abs(number) == float("inf"))

    return states.groupBy("format_id", "layer").agg(
        F.count("*").alias("n_rows"),
        F.min(F.size("embedding")).alias("min_size"),
        F.max(F.size("embedding")).alias("max_size"),
        F.bool_or(F.exists("embedding", broken)).alias("has_broken"),
    )
