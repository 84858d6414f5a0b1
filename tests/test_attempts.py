import pytest
from pyspark.sql import functions as F

from formlens.schemas import GENERATIONS
from formlens.sources.attempts import read_committed, uncommitted, write_attempt

IDS = [-40_000, -32_768, -1, 0, 1, 7, 8, 9, 32_767, 32_768, 32_769, 1 << 40]


def generations(spark, ids, formats=(0, 3)):
    return spark.createDataFrame([("e", f, i, f"{f}:{i}") for f in formats for i in ids], GENERATIONS)


def keys(table):
    return sorted((r["format_id"], r["example_id"]) for r in table.collect())


def test_a_second_attempt_does_only_the_rest(spark, tmp_path):
    path, work = str(tmp_path / "store"), generations(spark, IDS)
    assert keys(uncommitted(work, path)) == keys(work) and read_committed(spark, path).count() == 0
    write_attempt(generations(spark, IDS[::2], (3,)), path)
    left = uncommitted(work, path)
    assert keys(left) == sorted([(0, i) for i in IDS] + [(3, i) for i in IDS[1::2]]) and left.columns == work.columns
    write_attempt(left, path)
    assert uncommitted(work, path).isEmpty()
    assert sorted(read_committed(spark, path).collect()) == sorted(work.collect())
    write_attempt(work.limit(0), path)
    assert read_committed(spark, path).count() == 2 * len(IDS)


def test_an_aborted_attempt_leaves_nothing_that_counts(spark, tmp_path):
    path, work = str(tmp_path / "store"), generations(spark, range(100))
    broken = work.withColumn("generation", F.when(F.col("example_id") == 77, F.raise_error(F.lit("lost"))).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        write_attempt(broken, path)
    # All rows and bitmaps written, and no commit.
    work.write.parquet(f"{path}/rows/attempt=stopped")
    write_attempt(generations(spark, [5]), path)
    assert keys(read_committed(spark, path)) == [(0, 5), (3, 5)]
    assert len(keys(uncommitted(work, path))) == 198


def test_an_example_counts_once(spark, tmp_path):
    path, work = str(tmp_path / "store"), generations(spark, range(10))
    with pytest.raises(ValueError, match="twice"):
        write_attempt(work.unionByName(work), path)
    write_attempt(work, path)
    with pytest.raises(ValueError, match="earlier"):
        write_attempt(generations(spark, [9, 10]), path)
    assert read_committed(spark, path).count() == 20


def test_no_stored_text_is_read_to_resume(spark, tmp_path):
    path, work = str(tmp_path / "store"), generations(spark, range(10))
    write_attempt(work, path)
    files = uncommitted(work.select("experiment", "format_id", "example_id"), path).inputFiles()
    assert any("/bitmaps/" in name for name in files) and not any("/rows/" in name for name in files)
