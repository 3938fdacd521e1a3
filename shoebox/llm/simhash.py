"""SimHash near-duplicates: exact links at a small Hamming distance, without all pairs.

Fingerprints are made in Arrow batches, then only *distinct* fingerprints go on (copies collapse in
a map-side aggregation). Candidates meet in buckets: 64 bits in ``BLOCKS`` blocks, ``MAX_BITS``
differing bits leave ``BLOCKS - MAX_BITS`` blocks equal, so any linked pair shares the key of one
choice of that many blocks (an equi-key, sorted within partitions). Within a bucket, a pivot table
holds the Hamming distances to reference fingerprints; by the triangle inequality a pair whose
coordinates differ by more than ``MAX_BITS`` anywhere is discarded, and survivors are verified on the
fingerprints. Pivot cells alone can't be the join key: distances of random fingerprints gather
around 32, and every coordinate more would multiply the rows by up to three.

A bucket is searched breadth-first from one fingerprint at a time over those not yet reached, and
gives a tree of links (at most one row per member), never all pairs. A bucket larger than
``MAX_BUCKET`` distinct fingerprints isn't gathered: its members meet at *flip nodes* instead (one
side flips at most one free bit, the other at most two, so both are within three exactly if they
meet), which is linear in its size and exact.

Defined cases: null or empty text has fingerprint zero, linked like any other; null ids get a
fingerprint and the least id of their component, or null if it has none; repeated rows give
repeated rows; only the id and text columns are read; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from shoebox.llm.common import documents, free, lower_words, map_texts, row_digest
from shoebox.plans.components import connected_components
from shoebox.plans.tables import Scratch

MAX_BITS, BLOCKS, SHINGLE, SEED, MAX_BUCKET = 3, 5, 3, 42, 50_000
#: Reference fingerprints of the pivot table.
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(6)], np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats included."""
    words = lower_words(text)
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    n = max(1, len(words) - width + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    hashes = (digest(x, SEED) for x in shingles)
    for start in range(0, n, 65536):
        part = np.fromiter(itertools.islice(hashes, 65536), ">u8", min(65536, n - start))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, fp): fp is the fingerprint's bits as a signed long."""
    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)

    def make():
        def apply(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            fps = np.array([fingerprint(x, width) for x in texts], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(fps)], [*keys, "fp"])

        return apply

    return map_texts(docs.select(*keys, "text"), make, f"{kinds}, fp long")


def block_masks(blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> list[int]:
    """The masks of every choice of ``blocks - max_bits`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(one, blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_keys(fps: DataFrame, blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> DataFrame:
    """(choice, key, fp): a row per fingerprint and choice of blocks."""
    masks = F.array(*[F.lit(_signed(m)) for m in block_masks(blocks, max_bits)])
    return fps.select("fp", F.posexplode(masks).alias("choice", "mask")).select("choice", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")


def links_within(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Tree links (from, to) of one bucket's distinct fingerprints: members are joined by a chain
    of links exactly if a chain of distances of ``max_bits`` or less joins them in the bucket."""
    table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    left, src, dst = np.arange(len(fps)), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.arange(len(left))
            for k in range(len(PIVOTS)):
                near = near[np.abs(table[left[near], k] - table[at, k]) <= max_bits]
                if not len(near):
                    break
            near = near[np.bitwise_count(fps[left[near]] ^ fps[at]) <= max_bits]
            if len(near):
                found = left[near]
                src.append(np.full(len(found), at))
                dst.append(found)
                queue.extend(found.tolist())
                left = np.delete(left, near)
    if not src:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return fps[np.concatenate(src)].view(np.int64), fps[np.concatenate(dst)].view(np.int64)


def _links_of_runs(fps: np.ndarray, ends: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of consecutive runs; ``ends`` are their ends. Runs of two are done all at once."""
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    two = starts[sizes == 2]
    a, b = fps[two], fps[two + 1]
    keep = np.abs(np.bitwise_count(a[:, None] ^ PIVOTS).astype(np.int8) - np.bitwise_count(b[:, None] ^ PIVOTS).astype(np.int8)).max(axis=1, initial=0) <= max_bits
    keep[keep] = np.bitwise_count(a[keep] ^ b[keep]) <= max_bits
    src, dst = [a[keep].view(np.int64)], [b[keep].view(np.int64)]
    for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist()):
        x, y = links_within(fps[s:e], max_bits)
        src.append(x)
        dst.append(y)
    return np.concatenate(src), np.concatenate(dst)


def bucket_links(keys: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(src, dst) tree links of every bucket of ``keys``, streamed over sorted partitions."""

    def run(batches):
        kept = (np.empty(0, np.int64),) * 3
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                cols, last = kept, len(kept[0])
            else:
                new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("choice", "key", "fp")]
                cols = [np.concatenate([k, n]) for k, n in zip(kept, new)]
                last = None
            n = len(cols[0])
            if not n:
                continue
            change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            cut = last if last is not None else (change[-1] if len(change) else 0)
            ends = np.concatenate([change[change < cut], [cut]]) if cut else np.empty(0, np.int64)
            kept = tuple(c[cut:] for c in cols)
            if cut:
                src, dst = _links_of_runs(np.ascontiguousarray(cols[2][:cut]).view(np.uint64), ends, max_bits)
                if len(src):
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    spread = keys.select(F.col("choice").cast("long").alias("choice"), "key", "fp").repartition("choice", "key").sortWithinPartitions("choice", "key", "fp")
    return spread.mapInArrow(run, "src long, dst long")


def flip_links(keys: DataFrame, blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> DataFrame:
    """(src, dst) links of large buckets, linear in their size. ``max_bits`` of three at most: f and
    g are linked exactly if f with up to one flip meets g with up to two; a node that only has
    two-flip members links none."""
    if max_bits != 3:
        raise ValueError("flip nodes are made for a distance of three")
    free = [[i for i in range(64) if not m >> i & 1] for m in block_masks(blocks, max_bits)]
    ones = [[0, *(1 << i for i in f)] for f in free]
    twos = [[(1 << i) | (1 << j) for i, j in itertools.combinations(f, 2)] for f in free]
    flips = F.array(*[F.array(*[F.struct(F.lit(_signed(x)).alias("x"), F.lit(s).alias("two")) for s, v in ((0, o), (1, t)) for x in v]) for o, t in zip(ones, twos)])
    at = keys.select("fp", F.explode(F.get(flips, F.col("choice").cast("int"))).alias("flip"))
    at = at.select(F.col("fp").bitwiseXOR(F.col("flip.x")).alias("node"), "fp", F.col("flip.two").alias("two"))
    hubs = at.where("two = 0").groupBy("node").agg(F.min("fp").alias("hub"))
    return at.join(hubs, "node").where("fp <> hub").select(F.col("hub").alias("src"), F.col("fp").alias("dst")).distinct()


def near_components(fps: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS, blocks: int = BLOCKS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(fp, component): every distinct fingerprint of ``fps`` that has a link, with the least
    fingerprint reachable."""
    keys = bucket_keys(fps, blocks, max_bits)
    large = scratch.write(keys.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > max_bucket).select("choice", "key"))
    if large.isEmpty():
        links = bucket_links(keys, max_bits)
    else:
        links = bucket_links(keys.join(large, ["choice", "key"], "left_anti"), max_bits)
        links = links.unionByName(flip_links(keys.join(large, ["choice", "key"], "left_semi"), blocks, max_bits))
    return connected_components(links, scratch).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id reachable over links of ``max_bits`` or less."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs, width))
    least = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    near = near_components(least.select("fp"), scratch, max_bits)
    named = least.join(near, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    class_ids = named.join(ids, "component").select("fp", "component_id")
    return rows.join(class_ids, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: the one of least id, and of least digest where ids are
    equal. Rows without an id are chosen among themselves, one of each component. Decisions are by
    row digest, never by id alone, and only digests are joined."""
    scratch = Scratch(docs.sparkSession, "first")
    keys = free(docs, "r1", "r2")
    keyed = docs.select("*", *row_digest(docs, keys))
    marked = keyed.select(F.col("doc_id"), F.col("text"), *(F.col(k).alias(f"d{i}") for i, k in enumerate(keys)))
    rows = scratch.write(fingerprints(marked, width, ("doc_id", "d0", "d1")).withColumn("unnamed", F.col("doc_id").isNull()))
    row = F.struct("doc_id", "d0", "d1")
    least = scratch.write(rows.groupBy("fp", "unnamed").agg(F.min(row).alias("least")))
    near = near_components(least.select("fp").distinct(), scratch, max_bits)
    named = least.join(near, "fp", "left").select("fp", "unnamed", "least", F.coalesce("component", "fp").alias("component"))
    first = named.groupBy("component", "unnamed").agg(F.min("least").alias("first"))
    first = named.select("fp", "unnamed", "component").join(first, ["component", "unnamed"]).select("fp", "unnamed", "first.d0", "first.d1")
    at = rows.join(first.toDF("fp", "unnamed", "f0", "f1"), ["fp", "unnamed"])
    gone = at.where("d0 <> f0 or d1 <> f1").select("d0", "d1").distinct().toDF(*keys)
    kept = keyed.join(gone, keys, "left_anti")
    twice = scratch.write(rows.groupBy("d0", "d1").agg(F.count("*").alias("n")).where("n > 1").select("d0", "d1").toDF(*keys))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if twice.isEmpty():
        return kept.select(columns)
    once = kept.join(twice, keys, "left_semi").groupBy(*keys).agg(F.first(F.struct(*columns)).alias("row")).select("row.*")
    return kept.join(twice, keys, "left_anti").select(columns).unionByName(once)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
