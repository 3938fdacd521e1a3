import datetime as dt

import pytest
from pyspark.sql import functions as F

from shoebox.functions import scalar as S, vectors as V


def one(spark, col, schema=None, **values):
    schema = schema or ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'array<double>' if isinstance(v, list) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("x")).first()["x"]


def test_haversine(spark):
    d = one(spark, S.haversine("a", "b", "c", "d"), a=35.68, b=139.69, c=35.69, d=139.69)
    assert 800 < d < 1200


@pytest.mark.parametrize(
    "path, supported, kind",
    [("/a/b.JPG", True, "JPEG"), ("/a/_MG_1.cr2", True, "CR2"), ("/a/b.txt", False, "UNKNOWN"), ("/a/.jpg", False, "UNKNOWN"), ("b.jfif", True, "JPEG"), ("/a.jpg/b", False, "UNKNOWN"), ("/x/.h.dng", True, "DNG"), ("/x/a.b.NEF", True, "NEF")],
)
def test_suffix(spark, path, supported, kind):
    assert one(spark, S.supported_image("p"), p=path) is supported
    assert one(spark, S.detect_format("p"), p=path) == kind


@pytest.mark.parametrize("f, raw", [("CR2", True), (".nef", True), ("JPEG", False), ("", False), (None, False), ("dng+", True)])
def test_is_raw(spark, f, raw):
    assert one(spark, S.is_raw("f"), f=f) is raw


@pytest.mark.parametrize(
    "row, body",
    [((" Canon ", "R5", "1\t", "JPEG"), "Canon|R5|1"), ((None, None, "7", None), "||7"), (("Canon", "", "", "x"), "Canon|"), ((None, " ", "", "nef"), "Nikon NEF"), ((None, None, None, "Srw"), "unknown"), ((None,) * 4, "unknown")],
)
def test_body(spark, row, body):
    assert one(spark, S.body_signature(*"abcd"), "a string, b string, c string, d string", **dict(zip("abcd", row))) == body


@pytest.mark.parametrize(
    "ts, path, day",
    [(dt.datetime(2024, 6, 1, 23, 59), "/x/2020-01-01.jpg", "2024-06-01"), (None, "/x/a 2020-01-02_20210101.jpg", "2020-01-02"), (None, "/x/IMG_20249999_1.jpg", "2024-99-99"), (None, "/20200101/a.jpg", "?"), (None, "/x/.20200101", "2020-01-01")],
)
def test_time_key(spark, ts, path, day):
    assert one(spark, S.time_key("t", "p"), "t timestamp_ntz, p string", t=ts, p=path) == day


@pytest.mark.parametrize(
    "raw, t",
    [("2024:06:01 10:20:30", "2024-06-01 10:20:30"), ("2024-06-01T10:20:30", "2024-06-01 10:20:30"), ("2024/06/01 10:20", "2024-06-01 10:20:00"), ("2024-06-01T10:20:30+02:00", "2024-06-01 08:20:30"), ("2024-06-01T10:20:30Z", "2024-06-01 10:20:30"), ("no", None), ("", None), (None, None)],
)
def test_exif_timestamp(spark, raw, t):
    assert one(spark, F.date_format(S.exif_timestamp("r"), "yyyy-MM-dd HH:mm:ss"), r=raw) == t


def test_gps(spark):
    g = one(spark, S.gps_from_dms("a", "b", "c", "d"), a=[35.0, 30.0, 36.0], b="S", c=[139.0, 0.0, 0.0], d="E")
    assert g == [-35.51, 139.0]
    assert one(spark, S.gps_pair("g"), g=[1.0]) is None
    assert one(spark, S.gps_pair("g"), g=[1.0, 2.0, 3.0]) == [1.0, 2.0]


def test_crop(spark):
    assert one(spark, S.crop_rect("c"), c=[1.0, 2.0, 3.0]) == [1, 2, 3, 0]
    assert one(spark, S.crop_rect("c"), c=[1.0, 2.0, 3.0, 4.0, 5.0]) == [1, 2, 3, 4]


@pytest.mark.parametrize("v, n", [("3", 3), (" 4.9 ", 4), ("-4.9", -4), ("x", None), ("", None), (None, None), ("nan", None)])
def test_int_or_none(spark, v, n):
    assert one(spark, S.int_or_none("v"), v=v) == n


@pytest.mark.parametrize("text", ["not json", "[]", "{", "[{}]", None])
def test_exiftool_empty(spark, text):
    m = one(spark, S.parse_exiftool("t"), t=text)
    assert all(v is None for v in m.asDict().values())


def test_exiftool(spark):
    m = one(spark, S.parse_exiftool("t"), t='[{"Make": "A"}, {"Make": "", "CameraMake": "B", "Model": "  ", "ModifyDate": "2024:01:02 03:04:05", "Orientation": 6}]')
    assert (m.camera_make, m.camera_model, m.timestamp_utc, m.orientation) == ("B", "", dt.datetime(2024, 1, 2, 3, 4, 5), 6)


def test_cosine(spark):
    c = lambda a, b: one(spark, V.cosine("a", "b"), "a array<double>, b array<double>", a=a, b=b)
    assert c([1.0, 0.0], [0.0, 1.0]) == 0
    assert c([2.0, 0.0], [3.0, 0.0]) == 1
    assert c([0.0], [1.0]) == 0
    assert c([1.0], [1.0, 2.0]) is None
    assert c(None, [1.0]) is None


def test_hamming(spark):
    h = lambda a, b: one(spark, S.phash_hamming("a", "b"), "a long, b long", a=a, b=b)
    assert (h(-1, 0), h(5, 5), h(None, 1)) == (64, 0, 65)


def test_stars(spark):
    assert one(spark, S.star_attr("s"), "s int", s=None) == "0"
    assert one(spark, S.star_attr("s"), "s int", s=4) == "4"
    with pytest.raises(Exception, match="none to five stars"):
        one(spark, S.star_attr("s"), "s int", s=6)


def test_levels(spark):
    assert one(spark, S.hierarchy_levels("h"), h="Events| Japan 2024 ||Day 01") == ["Events", "Japan 2024", "Day 01"]
    assert one(spark, S.hierarchy_levels("h"), h=None) == []
