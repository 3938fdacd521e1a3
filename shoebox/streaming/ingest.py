"""Incremental ingest: new image files of a folder as a stream, upserted per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shoebox.functions.scalar import detect_format, supported_image
from shoebox.operators.store import Store, upsert_metadata
from shoebox.schema import MEDIA_ITEMS


def new_files(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (item_id, file_path, file_size, file_format). The source leaves out names that begin
    with ``_`` or ``.``; a full scan finds those."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", r"\Afile:/+", "/")
    rows = rows.select(path.alias("file_path"), F.col("length").alias("file_size")).where(supported_image("file_path"))
    return rows.select(F.sha2(F.col("file_path").cast("binary"), 256).substr(1, 32).alias("item_id"), "file_path", "file_size", detect_format("file_path").alias("file_format"))


def ingest(spark: SparkSession, root: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Run until no new files are left. A batch that runs again changes nothing, as ids come from paths."""

    def put(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(["item_id"])
        rows = fresh
        for field in MEDIA_ITEMS:
            if field.name not in rows.columns:
                value = {"color_fix_flag": F.lit(False), "is_primary_master": F.lit(True), "indexed_at": F.current_timestamp()}.get(field.name, F.lit(None))
                rows = rows.withColumn(field.name, value.cast(field.dataType))

        def change(old: DataFrame) -> DataFrame:
            known = upsert_metadata(old, fresh)
            return known.unionByName(rows.join(old.select("item_id"), "item_id", "left_anti").select(*MEDIA_ITEMS.names))

        if not fresh.isEmpty():
            store.update(change)

    return new_files(spark, root).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
