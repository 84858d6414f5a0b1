"""Stored hidden states: one Parquet folder per format and layer, or a bucketed table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens import schemas
from formlens.operators.states import select_layer
from formlens.sources.generations import replace_partitions

KEYS = ["format_id", "layer"]


def stored_layers(spark: SparkSession, path: str) -> DataFrame:
    """Format and layer of everything below ``path``; empty when nothing is there yet."""
    try:
        return spark.read.schema(schemas.HIDDEN_STATES).parquet(path).select(*KEYS).distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "format_id INT, layer INT")


def write_hidden_states(states: DataFrame, path: str, force: bool = True) -> None:
    """Store one folder per format and layer; unless ``force``, what is there stays."""
    if not force:
        states = states.join(stored_layers(states.sparkSession, path), KEYS, "left_anti")
    replace_partitions(states, path, KEYS)


def save_state_table(states: DataFrame, table: str, buckets: int) -> None:
    """A catalogue table bucketed by example: formats of one example can be joined without a shuffle.

    Worth it when differences are taken more than once. Read it with ``spark.table``.
    """
    rows = states.repartition(buckets, "example_id")  # the bucket function: every task writes one bucket
    writer = rows.write.mode("overwrite").partitionBy("layer").bucketBy(buckets, "example_id").sortBy("example_id")
    writer.format("parquet").saveAsTable(table)


def read_hidden_states(
    spark: SparkSession, path: str, layer: int | None = None, format_ids: list[int] | None = None
) -> DataFrame:
    """Stored states; other layers and formats are not read, and formats without states are skipped."""
    states = spark.read.schema(schemas.HIDDEN_STATES).parquet(path)
    if format_ids is not None:
        states = states.filter(F.col("format_id").isin(format_ids))
    return states if layer is None else select_layer(states, layer)
