"""Schemas of the media table, the scan log and results."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_V = T.ArrayType(_D)

MEDIA_ITEMS = T.StructType(
    [
        T.StructField("item_id", _S, False),
        T.StructField("file_path", _S, False),
        T.StructField("file_size", _L),
        T.StructField("file_format", _S),
        T.StructField("camera_make", _S),
        T.StructField("camera_model", _S),
        T.StructField("camera_serial", _S),
        T.StructField("timestamp_utc", T.TimestampNTZType()),
        T.StructField("gps", _V),
        T.StructField("p_hash", _L),
        T.StructField("dinov2_vector", _V),
        T.StructField("aesthetic_score", _D),
        T.StructField("crop_rect", _V),
        T.StructField("color_fix_flag", _B),
        T.StructField("event_id", _S),
        T.StructField("duplicate_group_id", _S),
        T.StructField("is_primary_master", _B),
        T.StructField("indexed_at", T.TimestampNTZType()),
    ]
)
METADATA = ("file_size", "file_format", "camera_make", "camera_model", "camera_serial", "timestamp_utc", "gps", "p_hash")
SIGNALS = ("dinov2_vector", "aesthetic_score")

SCAN_LOG = T.StructType(
    [T.StructField("id", _L), T.StructField("path", _S), T.StructField("status", _S), T.StructField("message", _S), T.StructField("logged_at", T.TimestampNTZType())]
)

EDITS = T.StructType(
    [T.StructField("event_title", _S), T.StructField("event_hierarchy", _S), T.StructField("star_rating", T.IntegerType()), T.StructField("flag", _S), T.StructField("keywords", T.ArrayType(_S))]
)
