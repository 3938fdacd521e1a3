"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``: every executor can read it
again, so losing one costs nothing but the tasks it ran. Where the setting is absent and Spark runs in one process
(tests), a folder of this process is set once; on a cluster an absent setting is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from shoebox.plans.ship import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; set to a fresh local one only where unset, and only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all of {master} shares")
        found = f"file://{tempfile.mkdtemp(prefix='shoebox-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def passing(spark: SparkSession, path: str) -> str:
    """``path``, deleted when the driver's JVM ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(p)  # only what is there can be marked
    files.deleteOnExit(p)
    return path


def clear(spark: SparkSession) -> None:
    """Delete all written tables of this library in the shared folder; results that still read them fail."""
    Scratch(spark, "clear")._delete(f"{shared_dir(spark)}/shoebox")


class Scratch:
    """A family of written tables that one query needs. ``drop`` frees a table early; all go when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = passing(spark, f"{shared_dir(spark)}/shoebox/{name}-{uuid.uuid4().hex[:12]}")
        self.n = 0

    def write(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and return a DataFrame that reads the written files."""
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shoebox_path = path
        return out

    def drop(self, table: DataFrame) -> None:
        """Delete the files of a table that this object wrote."""
        self._delete(table._shoebox_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
