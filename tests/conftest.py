import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from formlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark_ui_enabled="false",
        spark_sql_shuffle_partitions="8",
        spark_checkpoint_dir=str(tmp_path_factory.mktemp("shared")),
        spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def toy_examples(spark):
    rows = [
        (1, "What is six times seven?", "Just multiply. #### 42"),
        (2, "Nine birds sit on a wire and all of them fly away; how many stay?", "None of them stays. #### 0"),
        (3, "Ten hundreds are?", "A hundred is ten tens, so ten of them are a thousand. #### 1000"),
    ]
    return spark.createDataFrame(rows, "example_id BIGINT, question STRING, answer STRING")


def make_formats(spark, rows):
    """Rows of (format_id, transform, separator, space) with the usual descriptors and tags."""
    from formlens.operators.formats import with_descriptors

    return with_descriptors(spark.createDataFrame(rows, "format_id INT, transform STRING, separator STRING, space STRING"))
