"""Tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from formlens.session import scratch_path


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: computed once, safe from lost executors."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
