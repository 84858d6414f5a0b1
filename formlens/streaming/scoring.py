"""Scoring generations as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from formlens import schemas
from formlens.operators.scoring import FORMAT_KEYS, accuracy_of, predictions
from formlens.sources.tables import stored

SCORE_KEYS = ["experiment", "format_id", "example_id"]


def stream_generations(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.GENERATIONS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def score_stream(
    generations: DataFrame, references: DataFrame, scores_path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Score new generations against ``references`` and keep one row per generation.

    Every micro-batch goes to a folder of its own, named by the query (which its checkpoint
    keeps) and the batch. A retry overwrites it, so a lost executor or a restart never counts a
    row twice, and a query with a new checkpoint leaves the folders of others alone. No state is
    kept: what has been scored is in the folders. The references are stored once, not read from
    the examples for every batch; a generation without one is kept with a null.
    """
    references = stored(references.select("example_id", "reference", F.lit(True).alias("_known")), "references")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        scored = predictions(batch).join(references, "example_id", "left")
        correct = F.when(F.col("_known"), F.col("prediction").eqNullSafe(F.col("reference")))
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        rows = scored.select(*SCORE_KEYS, correct.alias("correct"))
        rows.write.mode("overwrite").parquet(f"{scores_path}/run={run}/batch_id={batch_id}")

    writer = generations.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def running_accuracy(spark: SparkSession, scores_path: str) -> DataFrame:
    """Accuracy of all that has been scored so far; the latest batch wins for an example scored twice.

    Generations without a reference don't count.
    """
    scores = spark.read.schema(f"{schemas.SCORES}, run STRING, batch_id BIGINT").parquet(scores_path)
    written = F.struct(F.col("_metadata.file_modification_time").alias("at"), "batch_id")
    latest = scores.filter("correct IS NOT NULL").groupBy(*SCORE_KEYS).agg(F.max_by("correct", written).alias("correct"))
    return accuracy_of(latest)


SCORED = "scored BINARY, correct BINARY"
COUNTERS = "experiment STRING, format_id INT, n_correct BIGINT, n_scored BIGINT"


# Ids are dealt to stripes in turn; a block is what a stripe has of a run of STRIPES * BLOCK ids.
STRIPES, BLOCK = 256, 1024
BLOCK_KEYS = [f"shiftright(example_id, {(STRIPES * BLOCK).bit_length() - 1}) AS run", f"CAST(pmod(example_id, {STRIPES}) AS INT) AS stripe"]


def _rescored(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What the newest scores of a block's examples change in its format's counters."""
    newest = None
    for rows in batches:
        rows = rows[["place", "prediction", "correct"]]
        rows = rows if newest is None else pd.concat([newest, rows])
        newest = rows.sort_values(["place", "prediction", "correct"]).drop_duplicates("place", keep="last")
    place, correct = newest["place"].to_numpy(dtype=np.int64), newest["correct"].to_numpy(dtype=bool)
    bits = state.get if state.exists else (bytes(BLOCK // 8), bytes(BLOCK // 8))
    scored, right = (np.unpackbits(np.frombuffer(some, dtype=np.uint8)).astype(bool) for some in bits)
    known, before = scored[place], right[place]
    if not known.all() or (before != correct).any():
        scored[place], right[place] = True, correct
        state.update((np.packbits(scored).tobytes(), np.packbits(right).tobytes()))
        gained, added = int(correct.sum()) - int(before.sum()), int((~known).sum())
        yield pd.DataFrame({"experiment": [key[0]], "format_id": [key[1]], "n_correct": [gained], "n_scored": [added]})


def accuracy_stream(
    generations: DataFrame, references: DataFrame, counters_path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep the accuracy per experiment and format up to date as generations come in.

    Spark's state store holds two bits per example of a format: that it was scored, and whether its newest
    generation is right. A row of the store is a block of up to 1,024 examples of one format, every 256th of a run of
    ids, which Python works off in one call; ids far apart have blocks, and calls, of their own. A batch looks up the
    blocks of its own examples alone; a new one adds to its format's counters, a re-scored one corrects them. The counters of a batch are those of the batch before plus what changed, one
    row per format in a folder named by query and batch. A retry starts from the same state and the
    same counters and overwrites its folder; a restart with the same checkpoint goes on from there.

    The last batch wins for an example that is scored again; within a batch it is the greatest prediction in the
    order of strings. Generations without a reference do not count. The references are stored once.
    """
    known = stored(references.select("example_id", "reference"), "references")
    scored = predictions(generations).join(known, "example_id")
    place = f"CAST(shiftright(example_id, {STRIPES.bit_length() - 1}) & {BLOCK - 1} AS INT) AS place"
    said = ["coalesce(prediction, '') AS prediction", "prediction <=> reference AS correct"]
    blocks = scored.selectExpr(*FORMAT_KEYS, *BLOCK_KEYS, place, *said).groupBy(*FORMAT_KEYS, "run", "stripe")
    changes = blocks.applyInPandasWithState(_rescored, COUNTERS, SCORED, "update", GroupStateTimeout.NoTimeout)

    def add_up(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = f"{counters_path}/run={spark.sparkContext.getLocalProperty('sql.streaming.queryId')}"
        counters = batch.groupBy(*FORMAT_KEYS).agg(F.sum("n_correct").alias("n_correct"), F.sum("n_scored").alias("n_scored"))
        if batch_id:
            counters = counters.union(spark.read.schema(COUNTERS).parquet(f"{folder}/batch_id={batch_id - 1}"))
            counters = counters.groupBy(*FORMAT_KEYS).agg(F.sum("n_correct").alias("n_correct"), F.sum("n_scored").alias("n_scored"))
        counters.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    writer = changes.writeStream.outputMode("update").foreachBatch(add_up).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest_accuracy(spark: SparkSession, counters_path: str) -> DataFrame:
    """Accuracy per experiment and format after the last batch of ``accuracy_stream``.

    A row per format and batch is all there is to read. Queries that share the path are expected
    to score different generations; their counters are added up.
    """
    counters = spark.read.schema(f"{COUNTERS}, run STRING, batch_id BIGINT").parquet(counters_path)
    last = counters.groupBy("run", *FORMAT_KEYS).agg(F.max_by(F.struct("n_correct", "n_scored"), "batch_id").alias("last"))
    total = last.groupBy(*FORMAT_KEYS).agg(F.sum("last.n_correct").alias("n_correct"), F.sum("last.n_scored").alias("n_scored"))
    return total.select(*FORMAT_KEYS, (F.col("n_correct") / F.col("n_scored")).alias("accuracy"), "n_scored")
