"""Shared helpers: reading documents, batching texts in Python workers, deterministic splits."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shoebox.plans.ship import ship

#: The white space of every contract: \x20 and \x09 to \x0D. bytes.split() splits at exactly these.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def id_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % modulus


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``df`` has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_digest(docs: DataFrame, names: list[str]) -> list[Column]:
    """128 bits of a whole row, never null, as two columns: rows that share an id, or have
    none, are told apart. Hashes skip nulls, so which columns are null is hashed as well."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    parts = [*cols, *(c.isNull() for c in cols)]
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in zip((1, 2), names)]


def most_frequent(counts: DataFrame, n: str, k: int) -> DataFrame:
    """At most ``k`` rows of ``counts``, those of largest ``n`` (positive); rows that are too many for their
    1 % step of ``n`` are left out together. A histogram of a fixed size decides, so no task ranks rows."""
    step = F.floor(F.log2(F.col(n)) * 64)
    taken, least = 0, None
    for row in sorted(counts.where(F.col(n) > 0).groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect(), reverse=True):
        taken += row["rows"]
        if taken > k:
            break
        least = row["step"]
    return counts.where(F.lit(False) if least is None else (F.col(n) > 0) & (step >= least))


def hash_sample(rows: DataFrame, key: str, k: int) -> DataFrame:
    """About ``k`` of the rows of distinct ``key``, all if they are fewer: those of a small hash."""
    total = rows.count()
    return rows if total <= k else rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < (k << 40) // total)


def words_of(text: str | None) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8; null counts as empty."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """As words_of with A-Z lower-cased: bytes.lower() changes only these."""
    return text.encode().lower().split() if text else []


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def chunks(batches: Iterator[pa.RecordBatch], max_chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with at most ``max_chars`` bytes of text (or one row), and the
    slice's texts with null as ''. Keeps a worker's memory bounded by the longest single text."""
    for batch in batches:
        col = batch.column("text")
        sizes = pc.fill_null(pc.binary_length(col.cast(pa.large_binary())), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > max_chars:
                part = batch.slice(start, i - start)
                yield part, [x or "" for x in part.column("text").to_pylist()]
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            part = batch.slice(start)
            yield part, [x or "" for x in part.column("text").to_pylist()]


def map_texts(df: DataFrame, make: Callable, schema: str, max_chars: int = 2_000_000) -> DataFrame:
    """``make()`` gives, once per task, a function (batch, texts) -> record batch or None; it is
    applied to slices of ``df``, which has a string column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for part, texts in chunks(batches, max_chars):
            out = apply(part, texts)
            if out is not None and out.num_rows:
                yield out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


class Memo(dict):
    """A dict that computes missing values and starts again at ``limit`` entries."""

    def __init__(self, f: Callable, limit: int = 400_000):
        super().__init__()
        self.f, self.limit = f, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.f(key)
        return value
