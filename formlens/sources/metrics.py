"""Accuracies as ``{"format_accuracies": [...]}``, one file per experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens import schemas


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The position in the list is the format id; a format without accuracy leaves a null."""
    by_format = F.map_from_entries(F.collect_list(F.struct("format_id", "accuracy")))
    grouped = metrics.groupBy("experiment").agg(by_format.alias("by_format"), F.max("format_id").alias("last"))
    listed = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.try_element_at(F.col("by_format"), i))
    rows = grouped.select("experiment", listed.alias("format_accuracies"))
    rows.repartition("experiment").write.mode("overwrite").partitionBy("experiment").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Accuracies by experiment and format. The experiment is the folder name."""
    files = spark.read.schema(schemas.METRICS).option("multiLine", True).option("mode", "FAILFAST")
    files = files.option("recursiveFileLookup", True).json(path)
    folder = F.regexp_extract(F.url_decode("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return files.select(
        F.regexp_replace(folder, "^experiment=", "").alias("experiment"),
        F.posexplode("format_accuracies").alias("format_id", "accuracy"),
    )
