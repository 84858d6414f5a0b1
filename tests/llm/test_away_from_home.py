"""All queries run from a folder without the package, which workers then cannot import."""

import os
import subprocess
import sys

import pytest

FOLDER = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from __spark_entry__ import queries
from formlens.session import build_session
sys.path.remove({repo!r})
spark = build_session("away", "local[4]", spark_ui_enabled="false", spark_sql_shuffle_partitions="4", spark_checkpoint_dir={shared!r})
spark.sparkContext.setLogLevel("OFF")
absent = lambda batches: (batch for batch in batches if __import__("importlib.util").util.find_spec("formlens") is None)
assert spark.range(3).mapInArrow(absent, "id long").count() == 3
for name, query in queries().items():
    if name.startswith("op") or name == "pipeline":
        print(name, query(spark, {folder!r}).count(), flush=True)
"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_queries_without_the_package_on_workers(tmp_path):
    away = tmp_path / "away"
    away.mkdir()
    script = SCRIPT.format(repo=REPO, shared=str(tmp_path / "shared"), folder=FOLDER)
    environment = {name: value for name, value in os.environ.items() if name != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", script], cwd=away, env=environment, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stderr[-3000:]
    assert len(run.stdout.split("\n")) >= 14
