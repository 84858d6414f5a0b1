"""Generations written by attempts that may be cut short, and resumed at single examples.

An attempt has a folder of rows and a folder of bitmaps, which tell the examples in it: one bit per
example, a row per experiment, format and run of 32,768 ids. It counts once its commit, a file of a
single row, is there; that appears in one step, after all else. What an aborted attempt left is
never read. To resume, the bitmaps are read and no stored text.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens import schemas

RUN = ["experiment", "format_id", "run"]
BITS = "experiment STRING, format_id INT, run BIGINT, n_rows BIGINT, bits BINARY, attempt STRING"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _of_committed(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    committed = _read(spark, f"{path}/commits", "attempt STRING, n_rows BIGINT").select("attempt")
    return _read(spark, f"{path}/{part}", schema).join(committed, "attempt", "left_semi")


def _run() -> Column:
    return F.bitmap_bucket_number(F.col("example_id")).alias("run")


def bitmaps(generations: DataFrame) -> DataFrame:
    """The examples of every experiment and format: a bit each, and the number of rows per run of ids."""
    return generations.groupBy("experiment", "format_id", _run()).agg(
        F.count("*").alias("n_rows"), F.bitmap_construct_agg(F.bitmap_bit_position(F.col("example_id"))).alias("bits")
    )


def committed_bitmaps(spark: SparkSession, path: str) -> DataFrame:
    """The bitmaps of all attempts that count, those of a run of ids put together."""
    return _of_committed(spark, path, "bitmaps", BITS).groupBy(*RUN).agg(F.bitmap_or_agg("bits").alias("bits"))


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The generations of all attempts that count."""
    return _of_committed(spark, path, "rows", f"{schemas.GENERATIONS}, attempt STRING").drop("attempt")


def uncommitted(work: DataFrame, path: str) -> DataFrame:
    """The rows of ``work`` (experiment, format, example and others) that no attempt has committed.

    The join is on runs of ids, of which each has 32,768 examples at most, so no key is hot.
    """
    stored = committed_bitmaps(work.sparkSession, path).withColumnRenamed("bits", "_bits").withColumnRenamed("run", "_run")
    place = F.bitmap_bit_position(F.col("example_id"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    done = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    keyed = work.withColumn("_run", _run()).join(stored, ["experiment", "format_id", "_run"], "left")
    return keyed.filter(~done).select(*work.columns)


def write_attempt(generations: DataFrame, path: str) -> str:
    """Write rows as one attempt, and commit it; returns its name.

    An example that the attempt holds twice, or an earlier one has committed, is an error, and the attempt
    does not count. One writer at a time: of two that overlap while both write, neither sees the other.
    """
    spark, attempt = generations.sparkSession, uuid.uuid4().hex
    columns = [field.split()[0] for field in schemas.GENERATIONS.split(", ")]
    generations.select(*columns).write.parquet(f"{path}/rows/attempt={attempt}")
    stored = spark.read.schema(schemas.GENERATIONS).parquet(f"{path}/rows/attempt={attempt}")
    bitmaps(stored).write.parquet(f"{path}/bitmaps/attempt={attempt}")
    own = spark.read.schema(BITS).parquet(f"{path}/bitmaps/attempt={attempt}").drop("attempt")
    both = own.unionByName(committed_bitmaps(spark, path).withColumn("n_rows", F.bitmap_count("bits")))
    runs = both.groupBy(*RUN).agg(F.sum("n_rows").alias("n_rows"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("n_examples"))
    if not runs.filter("n_rows <> n_examples").isEmpty():
        raise ValueError("an example is in the attempt twice, or in an earlier one")
    total = own.agg(F.lit(attempt).alias("attempt"), F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("n_rows"))
    total.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return attempt
