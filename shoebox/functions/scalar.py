"""Scalar functions as Spark columns: formats, bodies, days, timestamps, positions, scores.

All are built-in expressions, evaluated in the JVM. Null gives null unless a docstring says
otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed values.
JPEG_SUFFIXES = (".jpg", ".jpeg", ".jpe", ".jfif")
RAW_SUFFIXES = (".cr2", ".cr3", ".nef", ".arw", ".rw2", ".orf", ".dng", ".raf", ".pef", ".kdc", ".srw", ".x3f", ".sr2", ".mrw", ".3fr", ".fdc", ".iiq")
RAW_FAMILIES = ("CR2", "CR3", "NEF", "ARW", "RW2", "ORF", "RAF", "PEF", "SRW", "SR2", "KDC", "X3F", "MRW", "3FR", "FDC", "IIQ", "DNG")
EXTENSION_HINTS = {
    ".cr2": ("Canon", "Canon CR2"), ".cr3": ("Canon", "Canon CR3"), ".nef": ("Nikon", "Nikon NEF"), ".arw": ("Sony", "Sony ARW"),
    ".rw2": ("Panasonic", "Panasonic RW2"), ".orf": ("OM Systems", "OM Systems ORF"), ".raf": ("Fujifilm", "Fujifilm RAF"), ".pef": ("Pentax", "Pentax PEF"),
}
BODY_HINTS = {
    "CR2": "Canon CR2", "CR3": "Canon CR3", "NEF": "Nikon NEF", "ARW": "Sony ARW", "RW2": "Panasonic RW2",
    "ORF": "OM Systems ORF", "RAF": "Fujifilm RAF", "PEF": "Pentax PEF", "DNG": "Unknown DNG",
}
EARTH_RADIUS_M = 6_371_000.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c) -> Column:
    """Without white space of any kind at both ends; null counts as ''."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)^\s+|\s+\z", "")


def base_name(path) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)/*\z", 1)


def suffix(path) -> Column:
    """The lower-case suffix with its dot, or ''; a leading dot alone begins no suffix."""
    return F.lower(F.regexp_extract(col(path), r"[^./][^/]*?(\.[^./]+)/*\z", 1))


def stem(path) -> Column:
    """The base name without its last suffix."""
    return F.regexp_extract(col(path), r"\A(?s:.*/)?(\.?[^/]+?)(?:\.[^./]+)?/*\z", 1)


def supported_image(path) -> Column:
    """Whether the suffix is one of a JPEG or RAW file."""
    return suffix(path).isin(*JPEG_SUFFIXES, *RAW_SUFFIXES)


def detect_format(path) -> Column:
    """``JPEG``, the RAW suffix in upper case, or ``UNKNOWN``."""
    s = suffix(path)
    return F.when(s.isin(*JPEG_SUFFIXES), "JPEG").when(s.isin(*RAW_SUFFIXES), F.upper(F.substring(s, 2, 10))).otherwise("UNKNOWN")


def _lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    got = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    return F.coalesce(got, default)


def camera_hint(path) -> Column:
    """struct<make, model> known from the suffix alone; nulls for others."""
    s = suffix(path)
    none = F.lit(None).cast("string")
    return F.struct(*[_lookup(s, {k: v[i] for k, v in EXTENSION_HINTS.items()}, none).alias(n) for i, n in enumerate(("make", "model"))])


def is_raw(file_format) -> Column:
    """Whether a stored format names a RAW family; null and empty are not."""
    return F.coalesce(F.upper(col(file_format)).rlike(r"\A\.*(" + "|".join(RAW_FAMILIES) + ")"), F.lit(False))


def body_signature(make="camera_make", model="camera_model", serial="camera_serial", file_format="file_format") -> Column:
    """Key of the camera body: make|model|serial, make|model, or a hint from the format."""
    a, b, c = stripped(make), stripped(model), stripped(serial)
    hint = _lookup(F.upper(F.coalesce(col(file_format), F.lit(""))), BODY_HINTS, F.lit("unknown"))
    return F.when(c != "", F.concat_ws("|", a, b, c)).when((a != "") | (b != ""), F.concat_ws("|", a, b)).otherwise(hint)


def time_key(ts="timestamp_utc", path="file_path") -> Column:
    """Day of a photo: of its time, else a date in the stem, else eight digits in it, else ``?``."""
    name = stem(path)
    dashed = F.nullif(F.regexp_extract(name, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit(""))
    digits = F.nullif(F.regexp_extract(name, r"([0-9]{8})", 1), F.lit(""))
    plain = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    return F.coalesce(F.date_format(col(ts), "yyyy-MM-dd"), dashed, F.when(digits.isNotNull(), plain), F.lit("?"))


def event_title(day) -> Column:
    return F.when(col(day) != "?", F.concat(F.lit("Event on "), col(day))).otherwise("Untitled event")


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), F.lit(2)) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), F.lit(2))
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def phash_hamming(a, b) -> Column:
    """Differing bits; 65 if either is null."""
    return F.coalesce(F.bit_count(col(a).bitwiseXOR(col(b))), F.lit(65))


def exif_completeness() -> Column:
    """Share of make, model, serial, time and position that are there; '' counts as missing."""
    there = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("camera_make", "camera_model", "camera_serial")]
    there += [F.col("timestamp_utc").isNotNull(), F.col("gps").isNotNull()]
    return reduce(lambda x, y: x + y, [t.cast("int") for t in there]) / F.lit(5.0)


def relative(value: Column, most: Column) -> Column:
    return F.when(most > 0, F.least(F.lit(1.0), value / most)).otherwise(F.lit(0.0))


def quality_score(most_bytes: Column) -> Column:
    """RAW 0.5 else 0.4, plus 0.3 of the relative size and 0.2 of the completeness, within 0 to 1."""
    base = F.when(is_raw("file_format"), 0.5).otherwise(0.4)
    score = base + 0.3 * relative(F.coalesce("file_size", F.lit(0)), most_bytes) + 0.2 * exif_completeness()
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def exif_timestamp(raw) -> Column:
    """UTC time of ``YYYY:MM:DD HH:MM:SS`` and its kin (``-`` or ``/`` in the date, ``T`` between, no
    seconds), or of ISO text with an offset; without an offset it is UTC. Others give null."""
    t = F.regexp_replace(stripped(raw), r"\A([0-9]{4})[:/\-]([0-9]{2})[:/\-]([0-9]{2})", "$1-$2-$3")
    t = F.regexp_replace(t, r"\A([0-9\-]{10})T", "$1 ")
    offset = F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace(t, r"Z\z", "+00:00"), F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]XXX")), "UTC").cast("timestamp_ntz")
    plain = [F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm")]
    return F.coalesce(*plain, offset)


def int_or_none(c) -> Column:
    """Integer part of a number in text; null for anything else."""
    d = F.expr("null") if c is None else stripped(c).try_cast("double")
    return F.when(~F.isnan(d), d.try_cast("long"))


def dms_degrees(parts) -> Column:
    p = col(parts)
    return p[0] + p[1] / 60.0 + p[2] / 3600.0


def gps_from_dms(lat, lat_ref, lon, lon_ref) -> Column:
    """[lat, lon] in degrees from [degrees, minutes, seconds] lists and their reference letters."""
    sign = lambda ref, neg: F.when(F.lower(F.substring(stripped(ref), 1, 1)).isin(neg, "-"), -1.0).otherwise(1.0)
    whole = (F.size(col(lat)) >= 3) & (F.size(col(lon)) >= 3)
    return F.when(whole, F.array(dms_degrees(lat) * sign(lat_ref, "s"), dms_degrees(lon) * sign(lon_ref, "w")))


def gps_pair(gps) -> Column:
    """The first two numbers in their order; null if there are fewer."""
    return F.when(F.size(col(gps)) >= 2, F.slice(col(gps), 1, 2))


def crop_rect(crop) -> Column:
    """Four numbers: padded with zeros, or cut."""
    return F.when(col(crop).isNotNull(), F.slice(F.concat(col(crop), F.array_repeat(F.lit(0.0), 4)), 1, 4))


def parse_exiftool(json_text) -> Column:
    """struct of the metadata in an exiftool JSON array: its last object, each field from the first
    non-empty of its tags; nulls if the text is no such array."""
    last = F.try_element_at(F.from_json(col(json_text), "array<map<string,string>>"), F.lit(-1))
    first = lambda *tags: F.coalesce(*[F.when(last[t] != "", stripped(last[t])) for t in tags])
    return F.struct(
        first("Make", "CameraMake").alias("camera_make"),
        first("Model", "CameraModel").alias("camera_model"),
        first("SerialNumber", "CameraSerialNumber").alias("camera_serial"),
        exif_timestamp(first("DateTimeOriginal", "ModifyDate", "CreationDate")).alias("timestamp_utc"),
        int_or_none(first("Orientation")).alias("orientation"),
    )


def xml_escape(c) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def hierarchy_levels(c) -> Column:
    """Trimmed non-empty levels of ``a|b|c``; null has none."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), r"\|"), stripped)
    return F.filter(parts, lambda x: x != "")


def star_attr(stars) -> Column:
    """0 to 5 as text, null as 0; others raise an error."""
    s = col(stars)
    bad = F.raise_error(F.concat(F.lit("a rating has none to five stars, not "), s.cast("string"))).cast("string")
    return F.when(s.isNull(), "0").when(s.between(0, 5), s.cast("string")).otherwise(bad)


def xmp_flag(flag="flag", group="duplicate_group_id", master="is_primary_master") -> Column:
    """The edit's flag, else Yes or No for the master or a derivative of a duplicate group."""
    derived = F.when(F.coalesce(col(group), F.lit("")) != "", F.when(col(master), "Yes").otherwise("No"))
    return F.coalesce(F.nullif(col(flag), F.lit("")), derived)


def sidecar_path(path, out_dir: str | None = None) -> Column:
    name = F.concat(base_name(path), F.lit(".xmp"))
    return F.concat(col(path), F.lit(".xmp")) if out_dir is None else F.concat(F.lit(out_dir.rstrip("/") + "/"), name)
