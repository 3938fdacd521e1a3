"""Whole passes over a library: each reads the store, computes, and writes the store and its log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from shoebox.operators import dedup, events
from shoebox.operators.store import Store, scan_status, upsert_embeddings, upsert_metadata
from shoebox.plans.tables import Scratch
from shoebox.schema import MEDIA_ITEMS
from shoebox.sources import files, images


def scan_directory(store: Store, root: str, exiftool: str | None = None, log: bool = True) -> DataFrame:
    """Scan ``root``, put a row of every file in the store, those that can't be read included, and log each. Gives the
    scan's rows, written. Columns that a scan doesn't know (signals, event, group) stay as they are in known rows."""
    rows = Scratch(store.spark, "scan").write(files.scan(store.spark, root, exiftool))

    def change(old: DataFrame) -> DataFrame:
        fresh = rows.select(*MEDIA_ITEMS.names).join(old.select("item_id"), "item_id", "left_anti").select(*old.columns)
        return upsert_metadata(old, rows.drop("p_hash")).unionByName(fresh)

    if not rows.isEmpty():
        store.update(change)
        if log:
            store.append_log(scan_status(rows.withColumnRenamed("file_path", "path")))
    return rows


def run_embeddings(store: Store, cache: str, root: str = "", encoder: Callable | None = images.mean_encoder, pending: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """Signals of the store's files (``pending``: only of those without a vector), put in the store where they succeed.
    Gives the results with their item_id, written, and their statistics. ``cache`` is a folder that all executors reach."""
    items = store.items().where("dinov2_vector is null") if pending else store.items()
    wanted = items.select("item_id", F.col("file_path").alias("path"))
    found = images.signals(images.load(store.spark, wanted, cache, root), encoder, **options)
    results = Scratch(store.spark, "signals").write(found.join(wanted, "path"))
    good = results.where("error is null")
    if not good.isEmpty():
        store.update(lambda old: upsert_embeddings(upsert_metadata(old, good.select("item_id", "p_hash")), good.select("item_id", "dinov2_vector", "aesthetic_score")))
    return results, images.stats(results)


def run_dedup(store: Store, **options) -> DataFrame:
    """Groups and masters of the store's items, written to it; gives its new items."""
    store.update(lambda old: dedup.assign(old, **options))
    return store.items()


def run_clustering(store: Store, **options) -> DataFrame:
    """Events of the store's items, written to it; gives its new items."""
    store.update(lambda old: events.run_clustering(old, **options))
    return store.items()
