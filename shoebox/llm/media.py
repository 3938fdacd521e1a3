"""Media columns: content-defined chunks, stored once, reassembled and verified.

A text's payload (UTF-8, zero-padded to a positive multiple of 64) is stored as the samples of a
grey image 64 wide (PGM, 8 bits a sample). A rolling gear hash cuts the stored file into chunks, so equal
passages give equal chunks wherever they stand.

1. Chunk digests of all documents are counted by Spark (no bytes move). The repeated digests set
   bits in a filter of a *fixed* size (``FILTER_BITS``), the only thing that is broadcast.
2. A second scan cuts again and writes, for every document, its ordered chunk list and the chunks
   that are its own. Chunks that may be shared are written apart and brought to one row per digest.
   Own and shared chunks together are the chunk store. A full filter only sends more chunks the
   second way, never fewer.
3. Every file is rebuilt from the written tables, checked against the digest written with its
   list, and measured. A file of own chunks only is read back as it was written;
   the lists of the others join the store on the digest and are ordered per file, equal files once.

``media_store`` gives the result columns, the lists and the chunk store; all are written tables, or
views of them, in the shared folder.

Defined cases: a null text is empty (one block of 64 zeros); results depend only on the text, so
repeated rows and equal texts have equal values; only ``doc_id`` and ``text`` are read; an empty
table gives an empty table. A digest that doesn't match raises an error.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from shoebox.llm.common import documents, map_texts
from shoebox.plans.tables import Scratch

WIDTH, MIN_CHUNK, MASK_BITS, MAX_CHUNK, FILTER_BITS = 64, 512, 10, 8192, 1 << 26
#: Gear values: one pseudo-random number for each byte.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)

RESULT = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
RESULT_FIELDS = RESULT.replace(" ", ": ").replace(",:", ",")
RESULT_TYPE = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH)), len(data)


def to_media(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_media(media: bytes) -> bytes:
    """The samples of a stored image; its header must agree with them."""
    magic, shape, depth, samples = media.split(b"\n", 3)
    width, height = map(int, shape.split())
    if magic != b"P5" or depth != b"255" or width * height != len(samples):
        raise ValueError("not a stored payload")
    return samples


def cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for shift in (1, 2, 4, 8, 16):  # the sum over 32 bytes, each shifted by its age, by doubling
        h[shift:] += h[:-shift] << np.uint32(shift)
    marks = (np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist()
    ends, start = [], 0
    for at in [*marks, len(data)]:
        while at - start > MAX_CHUNK:
            start += MAX_CHUNK
            ends.append(start)
        if at - start >= MIN_CHUNK or (at == len(data) and at > start):
            ends.append(at)
            start = at
    return ends


def digest(chunk: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(chunk, digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def chunk_list(media: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
    ends = cuts(media)
    parts = [media[a:b] for a, b in zip([0, *ends], ends)]
    return parts, [digest(x) for x in parts]


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, and an 8 x 8 mean hash of the image."""
    x = np.frombuffer(payload, np.uint8)
    rows = x.reshape(-1, 8, WIDTH // 8).sum(axis=2)
    bands = np.array([b.mean(axis=0) if len(b) else np.zeros(8) for b in np.array_split(rows, 8)])
    bits = np.packbits(bands > bands.mean()).tobytes().hex()
    return f"mean={x.mean():.4f};dev={x.std():.4f};hash={bits}"


def read_back(media: bytes) -> dict:
    """Result columns of the stored bytes."""
    payload = from_media(media)
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-WIDTH:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(payload),
    }


def chunk_digests(docs: DataFrame) -> DataFrame:
    """(d1, d2) of every chunk of every document."""

    def make():
        def apply(batch, texts):
            found = [d for x in texts for d in chunk_list(to_media(payload_of(x)[0]))[1]]
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in found], pa.int64()) for i in (0, 1)], ["d1", "d2"])

        return apply

    return map_texts(docs.select("text"), make, "d1 long, d2 long")


def digest_filter(repeated: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit array with a bit set for each digest: ``bits / 64`` words at most reach the driver."""
    bit = F.col("d1").bitwiseAND(F.lit(bits - 1))
    words = repeated.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(d1 & 63 as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out


LIST = "array<struct<d1: bigint, d2: bigint>>"
LIST_TYPE = pa.list_(pa.struct([("d1", pa.int64()), ("d2", pa.int64())]))
OWN_TYPE = pa.list_(pa.struct([("idx", pa.int32()), ("bytes", pa.binary())]))
STORED = f"kind string, doc_id {{id}}, n_bytes long, p1 long, p2 long, whole boolean, list {LIST}, own array<struct<idx: int, bytes: binary>>, d1 long, d2 long, bytes binary"


class Stored(NamedTuple):
    """``columns`` (doc_id, result columns, chunk_list); ``lists`` (doc_id, n_bytes, p1, p2, list) of every
    document, (p1, p2) being the digest of its file; ``chunks`` (d1, d2, bytes), one row per digest."""

    columns: DataFrame
    lists: DataFrame
    chunks: DataFrame


def store(docs: DataFrame, shared, bits: int) -> DataFrame:
    """Rows by kind: ``doc`` (a document's chunk list and its own chunks; ``whole`` if all are) and
    ``chunk`` (bytes of a digest that may be shared)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        words, sent = shared.value, set()

        def maybe(ds: list[tuple[int, int]]) -> np.ndarray:
            at = np.array([d[0] for d in ds], np.int64) & (bits - 1)
            return (words[at >> 6] >> (at & 63)) & 1 == 1

        def apply(batch, texts):
            cols: dict[str, list] = {k: [] for k in ("kind", "row", "n_bytes", "p1", "p2", "whole", "list", "own", "d1", "d2", "bytes")}

            def put(kind, row=None, n=None, p=(None, None), whole=None, chunks=None, own=None, d=(None, None), data=None):
                for k, v in zip(cols, (kind, row, n, *p, whole, chunks, own, *d, data)):
                    cols[k].append(v)

            for row, text in enumerate(texts):
                payload, n = payload_of(text)
                media = to_media(payload)
                parts, ds = chunk_list(media)
                hits = maybe(ds).tolist()
                own = [{"idx": i, "bytes": data} for i, (data, hit) in enumerate(zip(parts, hits)) if not hit]
                put("doc", row, n, digest(media), not any(hits), [{"d1": x, "d2": y} for x, y in ds], own)
                for d, data, hit in zip(ds, parts, hits):
                    if hit and d not in sent:
                        sent.add(d)
                        put("chunk", d=d, data=data)
                if len(sent) > 200_000:
                    sent.clear()
            ids = batch.column("doc_id").take(pa.array(cols["row"], pa.int32()))
            long = {k: pa.array(cols[k], pa.int64()) for k in ("n_bytes", "p1", "p2", "d1", "d2")}
            arrays = [pa.array(cols["kind"], pa.string()), ids, long["n_bytes"], long["p1"], long["p2"], pa.array(cols["whole"], pa.bool_())]
            arrays += [pa.array(cols["list"], LIST_TYPE), pa.array(cols["own"], OWN_TYPE), long["d1"], long["d2"], pa.array(cols["bytes"], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["kind", "doc_id", *list(cols)[2:]])

        return apply

    return map_texts(docs.select("doc_id", "text"), make, STORED.format(id=kind))


def rebuild(files: DataFrame) -> DataFrame:
    """``files`` (p1, p2, parts array<struct<idx, bytes>> in order, n_chunks, other columns) with a column ``result``
    instead of ``parts``, read back from the joined parts."""
    keep = [c for c in files.columns if c != "parts"]

    def run(batches):
        for batch in batches:
            p1, p2, n, parts = (batch.column(c) for c in ("p1", "p2", "n_chunks", "parts"))
            results = []
            for i in range(batch.num_rows):
                got = parts[i].as_py()
                media = b"".join(x["bytes"] for x in got)
                if [x["idx"] for x in got] != list(range(n[i].as_py())) or digest(media) != (p1[i].as_py(), p2[i].as_py()):
                    raise ValueError("a rebuilt file differs from the stored one")
                results.append(read_back(media))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(results, RESULT_TYPE)], [*keep, "result"])

    kinds = ", ".join(f"{c} {files.schema[c].dataType.simpleString()}" for c in keep)
    return files.mapInArrow(run, f"{kinds}, result struct<{RESULT_FIELDS}>")


def media_store(docs: DataFrame, bits: int = FILTER_BITS) -> Stored:
    """Chunk lists and chunks of every document, written, and the result columns read back from them."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "media")
    repeated = chunk_digests(docs).groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1")
    shared = spark.sparkContext.broadcast(digest_filter(repeated, bits))
    stored = scratch.write(store(docs, shared, bits))
    shared_chunks = scratch.write(stored.where("kind = 'chunk'").groupBy("d1", "d2").agg(F.max("bytes").alias("bytes")))
    return read_store(stored, shared_chunks)


def read_store(stored: DataFrame, shared_chunks: DataFrame) -> Stored:
    """The operator's output from the two written tables, and from nothing else."""
    rows = stored.where("kind = 'doc'")
    whole = rows.where("whole").select("doc_id", "n_bytes", "p1", "p2", F.size("list").alias("n_chunks"), "list", F.col("own").alias("parts"))
    mixed = rows.where("not whole")
    at = mixed.select("p1", "p2", F.size("list").alias("n_chunks"), F.transform("own", lambda x: x["idx"]).alias("has"), F.posexplode("list").alias("idx", "d"))
    at = at.where("not array_contains(has, idx)").select("p1", "p2", "n_chunks", "idx", "d.d1", "d.d2").distinct()
    fetched = at.join(shared_chunks, ["d1", "d2"]).select("p1", "p2", "n_chunks", "idx", "bytes")
    own = mixed.select("p1", "p2", F.size("list").alias("n_chunks"), F.explode("own").alias("x")).select("p1", "p2", "n_chunks", "x.idx", "x.bytes")
    files = fetched.unionByName(own).groupBy("p1", "p2").agg(F.max("n_chunks").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("idx", "bytes"))).alias("parts"))
    # left: a file without a result, its chunks lost, is an error and not a missing row
    later = mixed.select("doc_id", "n_bytes", "p1", "p2", "list").join(rebuild(files), ["p1", "p2"], "left")
    found = F.when(F.col("result").isNotNull(), F.col("result")).otherwise(F.raise_error(F.lit("a stored file can't be rebuilt")).cast(f"struct<{RESULT_FIELDS}>"))
    later = later.withColumn("result", found)
    columns = rebuild(whole).select("doc_id", "n_bytes", "result.*", F.col("list").alias("chunk_list"))
    columns = columns.unionByName(later.select("doc_id", "n_bytes", "result.*", F.col("list").alias("chunk_list")))
    chunks = rows.select("list", F.explode("own").alias("x")).select(F.get("list", F.col("x.idx")).alias("d"), F.col("x.bytes").alias("bytes")).select("d.d1", "d.d2", "bytes")
    return Stored(columns, rows.select("doc_id", "n_bytes", "p1", "p2", "list"), chunks.unionByName(shared_chunks))


def media_columns(docs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, result columns, chunk_list) of every document, read back from its stored chunks."""
    return media_store(docs, bits).columns


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))
