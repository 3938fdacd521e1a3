"""Substring dedup: words covered by a repeated window of consecutive words are removed.

A De Bruijn graph of token k-mers: an edge is a window of ``window`` words, a node one word less; an edge
is known by its two nodes, whose words make up all of its own. Only repeated edges matter.

1. Candidates. Every window keeps the least-hashed of its ``kmer``-word k-mers. Equal windows keep the same
   k-mer at the same place, so an edge can only be repeated if its k-mer is. Neighbouring windows of a document that keep
   one k-mer form a *run*, a path of the graph with source coordinates. k-mers are counted by Spark; runs of repeated
   ones go on: by a broadcast filter of ``FILTER_BITS`` while the repeated k-mers set a sixteenth of its bits at most, by a
   semi-join as well beyond that, and by the semi-join alone once the filter would let nearly all pass. Results are equal.
2. Runs of equal words (a 128-bit digest of the words at the source coordinates) are one class. A class that is alone
   with its k-mer and occurs twice is a compacted path: none of its inner nodes branches. Classes that share a k-mer
   branch somewhere; they are taken apart into edges, and edges are counted.
3. In and out degrees of the nodes over all repeated edges and paths are sums by Spark. A node with one edge in and one
   out is no end: joined to it, the paths on both sides compact to one. That is done where documents walk: each
   document's repeated edges and paths, in order, are cut where a node branches or the walk leaves the
   repeated edges, and what lies between is one span (x, n): ``n`` windows from word ``x`` on.
4. Spans are joined to their documents by source coordinates, where the covered words go.

Counts and joins are on hashes, with map-side combine; a passage that a third of all documents share
is one class, and joins back over an exchange that AQE may split. Ordered work is within one class or document.

Defined cases: a null or empty text, or one shorter than a window, loses nothing; kept words are
joined by one space; repeated rows repeat each other's windows; a null id is an id of its own; other columns
than id and text aren't read by the query; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from shoebox.llm.common import Memo, documents, map_texts, sha256, words_of
from shoebox.llm.media import digest_filter
from shoebox.plans.tables import Scratch

WINDOW, KMER, FILTER_BITS = 35, 15, 1 << 27
_M = 0x9E3779B97F4A7C15 | 1
_INV = pow(_M, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(1, n), np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Runs:
    """Runs of windows over the words of some texts laid end to end."""

    def __init__(self, texts: list[list[bytes]], memo, window: int, k: int):
        sizes = np.array([len(w) for w in texts], np.int64)
        n = int(sizes.sum())
        ends = np.cumsum(sizes)
        self.words = [w for ws in texts for w in ws]
        self.text, self.x, self.n, self.kmer = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
        if n < window:
            return
        h = np.fromiter(map(memo.__getitem__, self.words), np.uint64, n)
        self.power = _powers(_M, n + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(h * _powers(_INV, n), dtype=np.uint64)])
        kmers = _mix(self.spans(np.arange(n - k + 1), k))
        starts = np.arange(n - window + 1)
        text = np.searchsorted(ends, starts, side="right")
        starts = starts[starts + window <= ends[text]]
        if not len(starts):
            return
        least = sliding_window_view(kmers, window - k + 1).argmin(axis=1)[starts] + starts
        first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        self.x = starts[first]
        self.n = np.diff(np.concatenate([first, [len(starts)]]))
        self.kmer = kmers[least[first]]
        self.text = np.searchsorted(ends, self.x, side="right")
        self.offset = self.x - (ends - sizes)[self.text]

    def spans(self, at: np.ndarray, length) -> np.ndarray:
        """Hash of ``length`` words from each place: sum of h[at + j] / M**j, the same anywhere."""
        return (self.sums[at + length] - self.sums[at]) * self.power[at]


def _runs(window: int, k: int):
    memo = Memo(lambda w: xxhash.xxh64_intdigest(w))
    return lambda texts: Runs([words_of(t) for t in texts], memo, window, k)


def edge_kmers(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(d1): the kept k-mer of every run."""

    def make():
        runs = _runs(window, k)
        return lambda batch, texts: pa.RecordBatch.from_arrays([pa.array(runs(texts).kmer.view(np.int64))], ["d1"])

    return map_texts(docs.select("text"), make, "d1 long")


def run_rows(docs: DataFrame, shared, bits: int, window: int, k: int) -> DataFrame:
    """(doc_id, th, x, m, v1, v2, nodes): runs, of k-mers in the filter ``shared`` if there is one; ``x`` the first window's
    first word, (v1, v2) the digest of the words, ``nodes`` one more than windows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        runs, filled = _runs(window, k), shared.value if shared else None

        def apply(batch, texts):
            r = runs(texts)
            keep = np.arange(len(r.kmer))
            if filled is not None:
                at = r.kmer.view(np.int64) & (bits - 1)
                keep = np.flatnonzero((filled[at >> 6] >> (at & 63)) & 1)
            if not len(keep):
                return None
            x, n, row = r.x[keep], r.n[keep], r.text[keep]
            sizes = n + 1
            ends = np.cumsum(sizes)
            each = np.repeat(x, sizes) + np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
            nodes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(_mix(r.spans(each, window - 1)).view(np.int64)))
            words = np.array([xxhash.xxh128_digest(b" ".join(r.words[a:b])) for a, b in zip(x.tolist(), (x + n + window - 1).tolist())], "S16")
            v = np.frombuffer(words.tobytes(), np.int64).reshape(-1, 2)
            th = np.array([xxhash.xxh64_intdigest(t.encode(), 42) for t in texts], np.uint64).view(np.int64)
            cols = [batch.column("doc_id").take(pa.array(row)), pa.array(th[row]), pa.array(r.offset[keep], pa.int32()), pa.array(r.kmer[keep].view(np.int64)), pa.array(v[:, 0].copy()), pa.array(v[:, 1].copy()), nodes]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "x", "m", "v1", "v2", "nodes"])

        return apply

    return map_texts(docs.select("doc_id", "text"), make, f"doc_id {kind}, th long, x int, m long, v1 long, v2 long, nodes array<long>")


def candidate_runs(docs: DataFrame, scratch: Scratch, window: int, k: int, bits: int) -> DataFrame:
    """The runs whose k-mer occurs twice, and with the filter alone a few more."""
    repeated = scratch.write(edge_kmers(docs, window, k).groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1"))
    n = repeated.count()
    shared = docs.sparkSession.sparkContext.broadcast(digest_filter(repeated, bits)) if n <= 2 * bits else None
    runs = run_rows(docs, shared, bits, window, k)
    return runs if 16 * n <= bits else runs.join(repeated.withColumnRenamed("d1", "m"), "m", "left_semi")


def through_nodes(edges: DataFrame) -> DataFrame:
    """(node) with one of the distinct ``edges`` (l, r) in and one out."""
    ends = edges.select(F.col("l").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("r").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")).where("in_degree = 1 and out_degree = 1").select("node")


def islands(rows: DataFrame, keys: list[str], at: str, n: str) -> DataFrame:
    """(keys, at, n, joins) of compacted neighbours: a row goes on from the one before if it begins where that
    ends and ``joins``."""
    order = W.partitionBy(*keys).orderBy(at)
    opens = F.when((F.lag(F.col(at) + F.col(n)).over(order) == F.col(at)) & F.col("joins"), 0).otherwise(1)
    marked = rows.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order))
    return marked.groupBy(*keys, "island").agg(F.min(at).alias(at), F.sum(n).cast("int").alias(n), F.min_by("joins", at).alias("joins")).drop("island")


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = KMER, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, th, spans array<struct<x, n>>): the ``n`` windows from word ``x`` on are repeated.
    Written to the shared folder."""
    scratch = Scratch(docs.sparkSession, "substrings")
    rows = scratch.write(candidate_runs(docs, scratch, window, k, bits))
    classes = scratch.write(rows.groupBy("m", "v1", "v2").agg(F.count("*").alias("c"), F.first("nodes").alias("nodes")))
    branching = scratch.write(classes.groupBy("m").agg(F.count("*").alias("k")).where("k > 1").select("m"))
    # compacted paths, and the edges of the classes that branch
    whole = classes.where("c > 1").join(branching, "m", "left_anti").select("v1", "v2", F.size("nodes").alias("n"), F.element_at("nodes", 1).alias("l"), F.element_at("nodes", -1).alias("r"))
    split = classes.join(branching, "m").select("v1", "v2", "c", "nodes", F.posexplode(F.slice("nodes", 1, F.size("nodes") - 1)).alias("i", "l"))
    split = split.select("v1", "v2", "c", "i", "l", F.get("nodes", F.col("i") + 1).alias("r"))
    edges = scratch.write(split.groupBy("l", "r").agg(F.sum("c").alias("c")).where("c > 1").select("l", "r"))
    through = scratch.write(through_nodes(whole.select("l", "r").unionByName(edges)))
    # pieces of each class that lie between branching nodes
    known = through.select(F.col("node").alias("l"), F.lit(True).alias("joins"))
    joins = F.coalesce("joins", F.lit(False)).alias("joins")
    paths = whole.join(known, "l", "left").select("v1", "v2", F.array(F.struct(F.lit(0).alias("off"), (F.col("n") - 1).alias("n"), joins)).alias("pieces"))
    walked = split.join(edges, ["l", "r"], "left_semi").join(known, "l", "left").select("v1", "v2", F.col("i").alias("off"), F.lit(1).alias("n"), joins)
    parts = islands(walked, ["v1", "v2"], "off", "n").groupBy("v1", "v2").agg(F.collect_list(F.struct("off", "n", "joins")).alias("pieces"))
    pieces = scratch.write(paths.unionByName(parts))
    # every document's walk, its pieces compacted at nodes that don't branch
    walks = rows.select("doc_id", "th", "x", "v1", "v2").join(pieces, ["v1", "v2"]).select("doc_id", "th", "x", F.explode("pieces").alias("p"))
    walks = walks.select("doc_id", "th", (F.col("x") + F.col("p.off")).alias("x"), F.col("p.n").alias("n"), "p.joins").distinct()
    out = scratch.write(islands(walks, ["doc_id", "th"], "x", "n").groupBy("doc_id", "th").agg(F.collect_list(F.struct("x", "n")).alias("spans")))
    for table in (rows, classes, branching, edges, through, pieces):
        scratch.drop(table)
    return out


def covered(n_words: int, spans: list[dict], window: int) -> np.ndarray:
    """Which words a repeated window covers."""
    edge = np.zeros(n_words + 1, np.int32)
    for span in spans:
        edge[span["x"]] += 1
        edge[min(n_words, span["x"] + span["n"] + window - 1)] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_repeated(docs: DataFrame, window: int = WINDOW, k: int = KMER, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, text, kept_sha256): ``text`` holds the kept words, or null."""
    docs = docs.select("doc_id", "text")
    runs = repeated_spans(docs, window, k).select(F.col("doc_id").alias("_id"), "th", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.withColumn("_th", F.xxhash64(F.coalesce("text", F.lit(""))))  # XXH64, seed 42, as in run_rows
    joined = keyed.join(runs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("th")), "left").select("doc_id", "text", "spans")

    def make():
        def apply(batch, texts):
            n, gone, kept, hashes = [], [], [], []
            for text, found in zip(texts, batch.column("spans").to_pylist()):
                words = words_of(text)
                n.append(len(words))
                if found:
                    cut = covered(len(words), found, window)
                    gone.append(int(cut.sum()))
                    words = [w for w, c in zip(words, cut.tolist()) if not c]
                else:
                    gone.append(0)
                data = b" ".join(words)
                hashes.append(sha256(data))
                kept.append(data.decode() if with_text else None)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(hashes)], ["doc_id", "n_words", "n_removed", "text", "kept_sha256"])

        return apply

    return map_texts(joined, make, f"doc_id {kind}, n_words long, n_removed long, text string, kept_sha256 string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(documents(spark, sf_dir), with_text=False).drop("text")


SQL = r"""
    WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS words FROM documents),
    pos AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
    win AS (SELECT doc_id, i, words[i] AS word, CASE WHEN i + 34 <= len(words) THEN sha256(array_to_string(words[i:i+34], ' ')) END AS h FROM pos),
    rep AS (SELECT *, CASE WHEN h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 THEN 1 ELSE 0 END AS r FROM win),
    cov AS (SELECT *, max(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM rep),
    kept AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed,
                    coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept FROM cov GROUP BY doc_id)
    SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)
"""
