"""A versioned Parquet store of the media table and its scan log.

Every write makes a new version directory and then moves a pointer file, so a failed write changes
nothing and readers of the old version go on. Mutations are joins over DataFrames (and usable without
the store): nothing is collected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from shoebox.operators.dedup import number_rows
from shoebox.schema import MEDIA_ITEMS, METADATA, SCAN_LOG, SIGNALS


def latest(new: DataFrame, key: str = "item_id", order: str | None = None) -> DataFrame:
    """One row for each key: the last by ``order`` (a column, dropped), or any of equal rows."""
    if order is None:
        return new.dropDuplicates([key])
    w = W.partitionBy(key).orderBy(F.desc(order))
    return new.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth", order)


def upsert(old: DataFrame, new: DataFrame, key: str = "item_id", order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in or in place, all columns, nulls included."""
    new = latest(new, key, order)
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def coalescing_update(old: DataFrame, new: DataFrame, columns: tuple[str, ...], key: str = "item_id") -> DataFrame:
    """``old`` with the non-null values of ``new`` in ``columns``; unknown keys change nothing."""
    have = [c for c in columns if c in new.columns]
    given = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in have]).dropDuplicates([key])
    joined = old.join(given, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in have else F.col(c) for c in old.columns])


def upsert_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """Partial update of the metadata columns; ``indexed_at`` stays."""
    return coalescing_update(old, new, METADATA)


def upsert_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Partial update of vector and score; ``indexed_at`` becomes now where either came."""
    marked = new.withColumn("indexed_at", F.when(F.coalesce(*[F.col(c).isNotNull().cast("int") for c in SIGNALS if c in new.columns]) >= 0, F.current_timestamp().cast("timestamp_ntz")))
    return coalescing_update(old, marked, (*SIGNALS, "indexed_at"))


def set_event(old: DataFrame, assignment: DataFrame) -> DataFrame:
    """Event of the items in ``assignment`` (item_id, event_id)."""
    return coalescing_update(old, assignment, ("event_id",))


def set_duplicate_group(old: DataFrame, assignment: DataFrame) -> DataFrame:
    """Group of the items in ``assignment`` (item_id, duplicate_group_id); the master flag stays."""
    return coalescing_update(old, assignment, ("duplicate_group_id",))


def append_log(log: DataFrame, new: DataFrame) -> DataFrame:
    """``log`` with rows (path, status, message) under the next ids, in path order."""
    start = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("start"))
    rows = number_rows(new.select("path", "status", "message"), [F.col("path").asc(), F.col("status").asc(), F.col("message").asc()], "n").crossJoin(F.broadcast(start))
    return log.unionByName(rows.select((F.col("n") + F.col("start")).alias("id"), "path", "status", "message", F.current_timestamp().cast("timestamp_ntz").alias("logged_at")))


def scan_status(results: DataFrame) -> DataFrame:
    """(path, status, message) of scan results: ``ok`` or ``error``."""
    return results.select("path", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), F.col("error").alias("message"))


class Store:
    """The two tables under one directory that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for name, schema in (("media_items", MEDIA_ITEMS), ("scan_log", SCAN_LOG)):
            if self._current(name) is None:
                self._commit(spark.createDataFrame([], schema), name)

    def _p(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _current(self, name: str) -> str | None:
        """The version of the last pointer; pointers are numbered, so a crash between writes is harmless."""
        at = self._p(name, "current")
        if not self._fs.exists(at):
            return None
        found = sorted((s.getPath().getName() for s in self._fs.listStatus(at)), key=lambda x: int(x.split("-", 1)[0]))
        return found[-1].split("-", 1)[1] if found else None

    def _commit(self, df: DataFrame, name: str) -> None:
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{name}/{version}")
        at = self._p(name, "current")
        n = len(self._fs.listStatus(at)) if self._fs.exists(at) else 0
        self._fs.mkdirs(at)
        self._fs.create(self._p(name, "current", f"{n}-{version}"), False).close()

    def _read(self, name: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{self._current(name)}")

    def items(self) -> DataFrame:
        return self._read("media_items", MEDIA_ITEMS)

    def log(self) -> DataFrame:
        return self._read("scan_log", SCAN_LOG)

    def item(self, item_id: str) -> DataFrame:
        return self.items().where(F.col("item_id") == item_id).limit(1)

    def count(self) -> int:
        return self.items().count()

    def pending_embeddings(self) -> DataFrame:
        return self.items().where("dinov2_vector is null").select("item_id")

    def batch_upsert(self, new: DataFrame, order: str | None = None) -> int:
        """All or nothing; the number of rows given, repeated keys counted (the last by ``order`` wins)."""
        n = new.count()
        if n:
            self._commit(upsert(self.items(), new, order=order), "media_items")
        return n

    def update(self, change) -> None:
        """``change``: a function of the media table, such as a partial of one above."""
        self._commit(change(self.items()), "media_items")

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the last ``keep`` versions of both tables; readers of older ones fail. Gives how many went."""
        gone = 0
        for name in ("media_items", "scan_log"):
            pointers = sorted((s.getPath().getName() for s in self._fs.listStatus(self._p(name, "current"))), key=lambda x: int(x.split("-", 1)[0]))
            for pointer in pointers[: -max(1, keep)]:
                gone += self._fs.delete(self._p(name, pointer.split("-", 1)[1]), True)
        return gone

    def append_log(self, new: DataFrame) -> None:
        self._commit(append_log(self.log(), new), "scan_log")
