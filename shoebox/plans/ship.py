"""Sends this package to the executors' Python workers, once for a context."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Make ``shoebox`` importable in Python workers wherever the driver found it (a zip of some
    hundred KB through ``addPyFile``)."""
    sc = spark.sparkContext
    if getattr(sc, "_shoebox_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp(prefix="shoebox-ship-"))  # of the driver, which serves the zip as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(package, folder / "root" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(folder / package.name), "zip", folder / "root"))
    sc._shoebox_shipped = True
