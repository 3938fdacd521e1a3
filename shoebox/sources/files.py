"""The photo library as a source: recursive listing, metadata, embedded previews.

Spark's file sources drop names that begin with ``_`` or ``.``, and cameras write such names, so
files are listed through pyarrow's file systems, level by level: the folders of a level are dealt to tasks, and what
they hold is written. Metadata are read by seeking to them, at any offset of a file.
"""

from __future__ import annotations

import functools
import hashlib
import json
import shutil
import subprocess
import sys
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shoebox.functions.scalar import EXTENSION_HINTS, JPEG_SUFFIXES, RAW_SUFFIXES, detect_format, exif_timestamp, gps_from_dms, int_or_none, suffix
from shoebox.plans.tables import Scratch
from shoebox.schema import MEDIA_ITEMS
from shoebox.sources import exif

THUMBS, SCAN_LIMIT = ".shoebox_thumbs", 16 << 20
SUFFIXES = JPEG_SUFFIXES + RAW_SUFFIXES
FILES = "path string, file_size long"
RAW_META = "make string, model string, serial string, timestamp string, orientation string, lat array<double>, lat_ref string, lon array<double>, lon_ref string"


def _system(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def _wanted(path: str) -> bool:
    name = path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return dot > 0 and name[dot:].lower() in SUFFIXES


def list_files(spark: SparkSession, root: str, thumbs: str = THUMBS, ordered: bool = False) -> DataFrame:
    """(path, file_size) of every file with a recognised suffix under ``root``, hidden names included, by path if
    ``ordered``; folders named ``thumbs`` are left out."""
    _, base = _system(root)
    scratch = Scratch(spark, "listing")

    def walk(batches: Iterator[pa.RecordBatch]):
        inner, _ = _system(root)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                rows = [x for x in inner.get_file_info(fs.FileSelector(folder)) if x.base_name != thumbs if x.type == fs.FileType.Directory or x.type == fs.FileType.File and _wanted(x.path)]
                if rows:
                    cols = [x.path for x in rows], [x.size for x in rows], [x.type == fs.FileType.Directory for x in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.bool_()))], ["path", "file_size", "folder"])

    found, level = [], spark.createDataFrame([(base,)], "path string")
    n = 1
    while n:
        held = scratch.write(level.repartition(min(n, 10_000), "path").mapInArrow(walk, FILES + ", folder boolean"))
        found.append(held.where("not folder").drop("folder"))
        level = held.where("folder").select("path")
        n = level.count()
    out = functools.reduce(DataFrame.unionByName, found)
    return out.orderBy("path") if ordered else out


def _read(system: fs.FileSystem, path: str, most: int) -> bytes:
    with system.open_input_stream(path) as f:
        return f.read(most)


def marker_preview(data: bytes, limit: int = SCAN_LIMIT) -> bytes | None:
    """The first JPEG within the first ``limit`` bytes: from its start marker to the first end marker,
    included, or to the end of those bytes. None without a start."""
    head = data[:limit]
    start = head.find(b"\xff\xd8")
    if start < 0:
        return None
    end = head.find(b"\xff\xd9", start + 2)
    return head[start:] if end < 0 else head[start : end + 2]


def embedded_previews(files: DataFrame, root: str = "", as_raw: bool = True) -> DataFrame:
    """(path, preview binary): the largest thumbnail that libraw knows, if it is installed, else the first
    embedded JPEG; null where there is none or the file can't be read."""

    def run(batches):
        system, _ = _system(root) if root else (fs.LocalFileSystem(), "")
        try:
            import rawpy
        except ImportError:
            rawpy = None
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                data = None
                if as_raw and rawpy is not None:
                    try:
                        with rawpy.imread(path) as raw:
                            thumb = raw.extract_thumb()
                            data = bytes(thumb.data) if thumb.format == rawpy.ThumbFormat.JPEG else None
                    except Exception:  # any damage falls back to the marker scan
                        data = None
                if data is None:
                    try:
                        data = marker_preview(_read(system, path, SCAN_LIMIT))
                    except OSError:
                        data = None
                out.append(data)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], ["path", "preview"])

    return files.select("path").mapInArrow(run, "path string, preview binary")


def find_exiftool(exiftool: str | None = "auto") -> str | None:
    """None: never; ``auto``: from PATH, else from the Python environment that runs this or lies beside the package; else
    the given path."""
    if exiftool != "auto":
        return exiftool
    beside = [Path(sys.prefix) / "bin" / "exiftool", Path(__file__).resolve().parents[2] / "venv" / "bin" / "exiftool"]
    return shutil.which("exiftool") or next((str(x) for x in beside if x.is_file()), None)


def _exiftool(exe: str, paths: list[str]) -> dict[str, dict]:
    try:
        got = subprocess.run([exe, "-j", "-n", *paths], capture_output=True, timeout=60 + len(paths), check=False)
        return {x.get("SourceFile"): x for x in json.loads(got.stdout or b"[]")}
    except (OSError, ValueError, subprocess.TimeoutExpired):
        return {}


def read_metadata(files: DataFrame, root: str = "", exiftool: str | None = None) -> DataFrame:
    """``files`` with ``meta`` (raw fields), ``source`` (exiftool, rawpy or none) and ``error``. A file that can't be
    read is a row with an error, never a failure."""
    schema = f"path string, file_size long, meta struct<{RAW_META.replace(' ', ':').replace(',:', ',')}>, source string, error string"
    meta_type = pa.struct([(n, pa.string()) for n in ("make", "model", "serial", "timestamp", "orientation")] + [("lat", pa.list_(pa.float64())), ("lat_ref", pa.string()), ("lon", pa.list_(pa.float64())), ("lon_ref", pa.string())])

    def first(d: dict, *tags):
        return next((str(d[t]).strip() for t in tags if d.get(t) not in ("", None)), None)

    def run(batches):
        system, _ = _system(root) if root else (fs.LocalFileSystem(), "")
        exe = find_exiftool(exiftool) if exiftool else None
        for batch in batches:
            paths = batch.column("path").to_pylist()
            tool = _exiftool(exe, paths) if exe else {}
            meta, source, error = [], [], []
            for path in paths:
                m, s, e = {}, "none", None
                if path in tool:
                    d = tool[path]
                    m = {"make": first(d, "Make", "CameraMake"), "model": first(d, "Model", "CameraModel"), "serial": first(d, "SerialNumber", "CameraSerialNumber")}
                    m |= {"timestamp": first(d, "DateTimeOriginal", "ModifyDate", "CreationDate"), "orientation": first(d, "Orientation")}
                    for c, tag in (("lat", "GPSLatitude"), ("lon", "GPSLongitude")):
                        if isinstance(d.get(tag), (int, float)):
                            m |= {c: [abs(float(d[tag])), 0.0, 0.0], f"{c}_ref": ("S" if c == "lat" else "W") if d[tag] < 0 else "N"}
                    s = "exiftool"
                else:
                    try:
                        with system.open_input_file(path) as f:
                            found = exif.read(exif.Seeking(f.read_at, f.size()))
                        m = {k: found.get(k) if isinstance(found.get(k), list) or found.get(k) is None else str(found[k]) for k in [x.name for x in meta_type]}
                        s = "rawpy"
                    except Exception as x:  # isolated per file
                        e = str(x)[:500]
                name = path.rsplit("/", 1)[-1]
                hint = EXTENSION_HINTS.get(name[name.rfind(".") :].lower())
                if hint and s == "rawpy":
                    m["make"], m["model"] = m.get("make") or hint[0], m.get("model") or hint[1]
                meta.append(m)
                source.append(s)
                error.append(e)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("file_size"), pa.array(meta, meta_type), pa.array(source), pa.array(error, pa.string())], ["path", "file_size", "meta", "source", "error"])

    return files.mapInArrow(run, schema)


def scan(spark: SparkSession, root: str, exiftool: str | None = None, previews: bool = False) -> DataFrame:
    """Rows of the media table for every file under ``root``, with ``orientation``, ``source``, ``error`` and, if
    asked for, ``preview``. The id is a digest of the path, so scanning again updates."""
    files = list_files(spark, root)
    files = files.repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    rows = read_metadata(files, root, exiftool)
    m = F.col("meta")
    out = rows.select(
        F.sha2(F.col("path").cast("binary"), 256).substr(1, 32).alias("item_id"),
        F.col("path").alias("file_path"), "file_size", detect_format("path").alias("file_format"),
        m.make.alias("camera_make"), m.model.alias("camera_model"), m.serial.alias("camera_serial"), exif_timestamp(m.timestamp).alias("timestamp_utc"),
        gps_from_dms(m.lat, m.lat_ref, m.lon, m.lon_ref).alias("gps"), int_or_none(m.orientation).alias("orientation"), "source", "error",
    )
    for field in MEDIA_ITEMS:
        if field.name not in out.columns:
            value = {"color_fix_flag": F.lit(False), "is_primary_master": F.lit(True), "indexed_at": F.current_timestamp()}.get(field.name, F.lit(None))
            out = out.withColumn(field.name, value.cast(field.dataType))
    out = out.select(*MEDIA_ITEMS.names, "orientation", "source", "error")
    if previews:
        raw = files.where(~suffix("path").isin(*JPEG_SUFFIXES))
        out = out.join(embedded_previews(raw, root).withColumnRenamed("path", "file_path"), "file_path", "left")
    return out


def preview_path(path: str, thumbs: str) -> str:
    """A name for a preview that no other file shares."""
    return f"{thumbs.rstrip('/')}/{hashlib.sha256(path.encode()).hexdigest()[:32]}.jpg"


def preview_column(path: str, thumbs: str) -> Column:
    """``preview_path`` of a column."""
    return F.concat(F.lit(thumbs.rstrip("/") + "/"), F.sha2(F.col(path).cast("binary"), 256).substr(1, 32), F.lit(".jpg"))
