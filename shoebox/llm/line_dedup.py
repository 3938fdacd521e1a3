"""Line dedup with DataFrame operations only.

1. Every line becomes (128-bit key hash, document, position), without its text. The rows
   are written once (a few hundredths of the input), range-partitioned by hash *and document*, so the ranges that Spark samples split a hot line
   over many tasks, and sorted within partitions by document and position.
2. Streaming over that order, the first occurrence of a key in a document counts the document
   (the window needs no second exchange: a range partitioning by (hash, document) already keeps
   its groups whole). Documents per key are summed with map-side combine.
3. Lines of frequent keys become one bit each: 64 lines a word, or-ed per document and word. The
   result is a compressed bitmap per document (only words that drop a line are kept).
4. ``apply_bitmaps`` joins the bitmaps to the documents and cuts the lines out.

Defined cases: a null or empty text is one empty line; an empty key (shorter than ``min_chars``)
never counts; a document is an (id, text) pair, so exact repeats of a row count once and get equal
results, and a null id is an id of its own; other columns of the input are kept by
``apply_bitmaps`` except those it adds; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from shoebox.llm.common import SPACE, documents, free
from shoebox.plans.tables import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 1) -> DataFrame:
    """(doc, th, pos, h1, h2): a row per line whose key has ``min_chars`` code points or more.
    ``th`` is the text's hash, which with ``doc`` names the document."""
    d = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("th"), F.posexplode(_lines(F.col(text))).alias("pos", "line"))
    key = F.translate(F.btrim(F.col("line"), F.lit(SPACE)), UPPER, LOWER)
    d = d.select("doc", "th", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    return d.select("doc", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("2"), "key").alias("h2"))


def drop_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc, th, n_dropped, words array<struct<word, bits>>) for the documents that lose lines:
    bit ``pos % 64`` of word ``pos / 64`` is set if line ``pos`` (from 0) goes."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows = scratch.write(line_rows(docs, doc_id, text, min_chars))
    ranged = rows.repartitionByRange("h1", "h2", "doc", "th").sortWithinPartitions("h1", "h2", "doc", "th", "pos")
    nth = F.row_number().over(W.partitionBy("h1", "h2", "doc", "th").orderBy("pos"))
    firsts = ranged.withColumn("nth", nth).where("nth = 1")
    frequent = scratch.write(firsts.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2"))
    gone = rows.join(frequent, ["h1", "h2"], "left_semi")
    word = (F.col("pos") / 64).cast("int")
    bits = gone.groupBy("doc", "th", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return bits.groupBy("doc", "th").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words")
    )


def _dense_keep(words: str) -> Column:
    """The keep words of a drop bitmap, from word 0 to the last that drops a line."""
    return F.expr(
        f"""flatten(transform({words}, (e, j) -> concat(
              array_repeat(-1L, e.word - if(j = 0, -1, {words}[greatest(j - 1, 0)].word) - 1), array(~e.bits))))"""
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced by the kept lines, and n_lines, n_dropped added."""
    added = docs.drop("n_lines", "n_dropped")
    doc, th, gone, keep, key = free(added, "doc", "th", "gone", "keep", "key")
    maps = bitmaps.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("n_dropped").alias(gone), _dense_keep("words").alias(keep))
    joined = added.withColumn(key, F.xxhash64(F.col(f"`{text}`"))).join(maps, F.col(f"`{doc_id}`").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(th)), "left")
    kept = F.expr(
        f"""array_join(filter(split(coalesce(`{text}`, ''), '\\n', -1),
              (x, i) -> (shiftright(coalesce(get(`{keep}`, cast(i / 64 as int)), -1L), i % 64) & 1L) = 1L), '\\n')"""
    )
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return joined.select(
        *[F.when(F.col(gone).isNull(), whole).otherwise(kept).alias(text) if c == text else F.col(f"`{c}`") for c in added.columns],
        F.size(_lines(F.col(f"`{text}`"))).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` without the lines whose key is in ``min_docs`` documents or more."""
    return apply_bitmaps(docs, drop_bitmaps(docs, doc_id, text, min_docs, min_chars), doc_id, text)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Kept lines of ``documents`` in DuckDB: kept(doc_id, n_lines, n_dropped, kept).
KEPT_SQL = """
    lines AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
      FROM {docs}),
    keyed AS (
      SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
    kept AS (
      SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '') AS kept
      FROM keyed LEFT JOIN frequent f USING (key) GROUP BY doc_id)
"""
SQL = "WITH " + KEPT_SQL.format(docs="documents") + "SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM kept"
