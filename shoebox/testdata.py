"""A media table derived from the driver's ``events`` and ``embeddings``, in Spark and in DuckDB SQL."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession, functions as F

from shoebox.plans.tables import Scratch
from shoebox.schema import MEDIA_ITEMS


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def media_items(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Photos with copies, cameras, positions and gaps: one row per event, over all vectors. The SQL cuts ids at seven characters, so
    from a million events on they repeat; ``whole`` ids don't, and begin with the cut ones (``cut_ids``)."""
    vectors = read(spark, sf_dir, "embeddings")
    signs = " | ".join(f"if(v[{i}] > 0, {1 << i if i < 63 else -(1 << 63) + 1}L{'' if i < 63 else ' - 1L'}, 0L)" for i in range(64))
    v = vectors.select(F.col("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("v")).withColumn("s", F.expr(signs))
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("e"), "ts", "user_id", "event_type", "value")
    e = e.crossJoin(F.broadcast(vectors.agg(F.count("*").alias("nv"))))  # one number
    e = e.selectExpr("*", "e % nv as k", "cast((e div nv) % 4 as int) as c", "cast((e div (4 * nv)) % 64 as int) as f", "cast((e div 8) % 3 as int) as blk").drop("nv")
    d = e.repartition(spark.sparkContext.defaultParallelism).join(v, "k")  # the file is small, the rows made of it aren't
    bits = "shiftrightunsigned(s, f) | shiftleft(s, 64 - f)"  # element i of the rotated vector is v[(i + f) % 64]; a shift by 64 is one by 0
    name = "lpad(cast(e as string), greatest(6, length(cast(e as string))), '0')" if whole else "lpad(cast(e as string), 6, '0')"
    raw = "c = 0 and event_type <> 'view'"
    none = "cast(null as {})".format
    return d.selectExpr(
        f"concat('m', {name}) as item_id",
        f"""concat('/lib/u', user_id, '/', case when k % 22 = 0 then concat('IMG_202401', lpad(cast(1 + k % 28 as string), 2, '0'))
            when k % 33 = 0 then 'scan 2024-01-20 x' else 'DSC' end, '_', lpad(cast(e as string), 6, '0'),
            case when {raw} then '.NEF' else '.jpg' end) as file_path""",
        "cast(round(1000000 + value * 1000) as bigint) as file_size",
        f"case when {raw} then case event_type when 'click' then 'CR2' when 'signup' then 'NEF' when 'purchase' then 'ARW' else 'DNG' end else 'JPEG' end as file_format",
        "case when k % 13 = 0 then null else element_at(array('Canon', 'Nikon', 'Sony'), blk + 1) end as camera_make",
        "case when k % 13 = 0 then null else concat('M', blk) end as camera_model",
        "case when k % 7 = 0 then null else concat('SN', blk) end as camera_serial",
        "case when k % 11 = 0 then null else cast(ts as timestamp_ntz) end as timestamp_utc",
        "case when k % 5 = 0 then null else array(35.68D + ((e div 4) % 3) * 0.0001D + if((e div 32) % 5 = 0, 1D, 0D), 139.69D) end as gps",
        f"case when k % 23 = 0 then null else ({bits}) ^ (case c when 2 then 7L when 3 then 1L else 0L end) end as p_hash",
        "concat(array(v[f] + case c when 2 then 0.1D when 3 then 0.5D else 0D end), slice(v, f + 2, 63 - f), slice(v, 1, f)) as dinov2_vector",
        f"{none('double')} as aesthetic_score", f"{none('array<double>')} as crop_rect", "false as color_fix_flag", f"{none('string')} as event_id",
        f"{none('string')} as duplicate_group_id", "true as is_primary_master", f"{none('timestamp_ntz')} as indexed_at",
    ).select(*MEDIA_ITEMS.names)


def cut_ids(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with whole ids cut as the SQL cuts them."""
    return df.withColumns({c: F.substring(c, 1, 7) for c in columns or ("item_id",)})


def stored_items(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """``media_items`` written once, for operators that read the table several times."""
    return Scratch(spark, "items").write(media_items(spark, sf_dir, whole))


#: The same table for DuckDB, as the beginning of a WITH list.
MEDIA_SQL = """WITH RECURSIVE media_d AS (
    SELECT event_id AS e, ts, user_id, event_type, value, event_id % nv AS k, (event_id // nv) % 4 AS c, (event_id // (4 * nv)) % 64 AS f, (event_id // 8) % 3 AS blk,
           embedding::DOUBLE[] AS v FROM events CROSS JOIN (SELECT count(*) AS nv FROM embeddings) JOIN embeddings ON vec_id = event_id % nv),
  media_r AS (SELECT *, list_concat(v[f + 1:64], v[1:f]) AS r FROM media_d),
  media_h AS (SELECT *, list_sum(list_transform(range(64), lambda i: CASE WHEN r[i + 1] > 0 THEN (1::HUGEINT << i) ELSE 0::HUGEINT END))::HUGEINT AS h FROM media_r),
  media_items AS (SELECT
    'm' || lpad(e::VARCHAR, 6, '0') AS item_id,
    '/lib/u' || user_id || '/' || CASE WHEN k % 22 = 0 THEN 'IMG_202401' || lpad((1 + k % 28)::VARCHAR, 2, '0') WHEN k % 33 = 0 THEN 'scan 2024-01-20 x' ELSE 'DSC' END
      || '_' || lpad(e::VARCHAR, 6, '0') || CASE WHEN c = 0 AND event_type <> 'view' THEN '.NEF' ELSE '.jpg' END AS file_path,
    round(1000000 + value * 1000)::BIGINT AS file_size,
    CASE WHEN c = 0 AND event_type <> 'view' THEN CASE event_type WHEN 'click' THEN 'CR2' WHEN 'signup' THEN 'NEF' WHEN 'purchase' THEN 'ARW' ELSE 'DNG' END ELSE 'JPEG' END AS file_format,
    CASE WHEN k % 13 = 0 THEN NULL ELSE ['Canon', 'Nikon', 'Sony'][blk + 1] END AS camera_make,
    CASE WHEN k % 13 = 0 THEN NULL ELSE 'M' || blk END AS camera_model,
    CASE WHEN k % 7 = 0 THEN NULL ELSE 'SN' || blk END AS camera_serial,
    CASE WHEN k % 11 = 0 THEN NULL ELSE ts END AS timestamp_utc,
    CASE WHEN k % 5 = 0 THEN NULL ELSE [35.68::DOUBLE + ((e // 4) % 3) * 0.0001::DOUBLE + CASE WHEN (e // 32) % 5 = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END, 139.69::DOUBLE] END AS gps,
    CASE WHEN k % 23 = 0 THEN NULL ELSE xor((CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END)::BIGINT, CASE c WHEN 2 THEN 7 WHEN 3 THEN 1 ELSE 0 END::BIGINT) END AS p_hash,
    list_concat([r[1] + CASE c WHEN 2 THEN 0.1::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0::DOUBLE END], r[2:64]) AS dinov2_vector,
    NULL::DOUBLE AS aesthetic_score, NULL::DOUBLE[] AS crop_rect, FALSE AS color_fix_flag, NULL::VARCHAR AS event_id, NULL::VARCHAR AS duplicate_group_id, TRUE AS is_primary_master,
    NULL::TIMESTAMP AS indexed_at FROM media_h)"""


def exif_jpeg(make: str, taken: str, lat: tuple[str, int, int, int], lon: tuple[str, int, int, int]) -> bytes:
    """A JPEG of markers alone, with make, time and position (reference letter, degrees, minutes, seconds)."""
    texts = make.encode() + b"\0", taken.encode() + b"\0"
    sub_at, gps_at, heap = 50, 68, 122
    at = [heap, heap + len(texts[0])]
    at += [at[1] + len(texts[1]), at[1] + len(texts[1]) + 24]
    entry = lambda tag, kind, n, value: struct.pack("<HHII", tag, kind, n, value)
    directory = lambda *rows: struct.pack("<H", len(rows)) + b"".join(rows) + struct.pack("<I", 0)
    block = b"II*\0" + struct.pack("<I", 8) + directory(entry(0x010F, 2, len(texts[0]), at[0]), entry(0x8769, 4, 1, sub_at), entry(0x8825, 4, 1, gps_at))
    block += directory(entry(0x9003, 2, len(texts[1]), at[1]))
    block += directory(entry(1, 2, 2, ord(lat[0])), entry(2, 5, 3, at[2]), entry(3, 2, 2, ord(lon[0])), entry(4, 5, 3, at[3]))
    block += b"".join(texts) + b"".join(struct.pack("<II", x, 1) for x in (*lat[1:], *lon[1:]))
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xd9"
