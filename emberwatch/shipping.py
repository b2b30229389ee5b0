"""Getting the package to the executors of a cluster."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to all Python workers, once per application.

    Not needed where it is installed on every node, or where PYTHONPATH leads all workers to it.
    """
    package = Path(__file__).resolve().parent
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        folder = tempfile.mkdtemp(prefix="emberwatch-package-")
        archive = shutil.make_archive(f"{folder}/emberwatch", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(application)
