from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

from emberwatch.sources import store

REPO = Path(__file__).resolve().parents[1]
SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
print("rows", entry.queries()["detect_brute_force"](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_workers_get_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(REPO / "__spark_entry__.py"), str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "rows " in out.stdout, out.stderr[-2000:]


class _Session:
    """Just enough of a session: a master and no shared folder."""

    def __init__(self, master):
        self.conf = self
        self.sparkContext = self
        self.master = master

    def get(self, key, default=None):
        return default

    def getConf(self):
        return self


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="checkpoint.dir"):
        store.shared_folder(_Session(master))


def test_scratch_tables_are_cleared(spark):
    kept = store.materialize(spark.range(3), "kept")
    store.materialize(spark.range(3), "gone")
    store.clear_scratch(spark, "gone")
    top = Path(f"{store.shared_folder(spark)}/{spark.sparkContext.applicationId}")
    assert not list(top.glob("gone-*")) and list(top.glob("kept-*")) and kept.count() == 3
