import struct

import numpy as np
import pytest

from shoebox.operators import library
from shoebox.operators.store import Store
from shoebox.plans import tables
from shoebox.registry import fixture_tree
from shoebox.sources import exif, files, images
from shoebox.streaming import ingest


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    return fixture_tree(spark, str(tmp_path_factory.mktemp("tree")))


def exif_jpeg(south=True):
    """A JPEG head with make, time and a position."""
    rational = lambda *v: b"".join(struct.pack("<II", int(x * 100), 100) for x in v)
    heap, base = b"", 8 + 2 + 12 * 3 + 4 + 2 + 12 * 1 + 4 + 2 + 12 * 4 + 4

    def put(data):
        nonlocal heap
        at = base + len(heap)
        heap += data
        return at

    entry = lambda tag, kind, n, value: struct.pack("<HHI", tag, kind, n) + (value if isinstance(value, bytes) else struct.pack("<I", value))
    sub_at = 8 + 2 + 36 + 4
    gps_at = sub_at + 2 + 12 + 4
    ifd0 = struct.pack("<H", 3) + entry(0x010F, 2, 6, put(b"Canon\0")) + entry(0x8769, 4, 1, sub_at) + entry(0x8825, 4, 1, gps_at) + struct.pack("<I", 0)
    sub = struct.pack("<H", 1) + entry(0x9003, 2, 20, put(b"2024:06:01 10:20:30\0")) + struct.pack("<I", 0)
    gps = struct.pack("<H", 4) + entry(1, 2, 2, b"S\0\0\0" if south else b"N\0\0\0") + entry(2, 5, 3, put(rational(35, 30, 36))) + entry(3, 2, 2, b"W\0\0\0") + entry(4, 5, 3, put(rational(10, 0, 0))) + struct.pack("<I", 0)
    block = b"Exif\0\0II*\0" + struct.pack("<I", 8) + ifd0 + sub + gps + heap
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xd9"


def test_listing(spark, tree):
    got = sorted(r.path[len(tree) + 1 :] for r in files.list_files(spark, tree).collect())
    assert got == ["_MG_0001.JPG", "photo.jpg", "sub/.hidden.jpg", "sub/other.jpeg", "sub/shot.dng"]


def test_scan(spark, tree):
    got = {r.file_path[len(tree) + 1 :]: r for r in files.scan(spark, tree, previews=True).collect()}
    assert got["sub/shot.dng"].file_format == "DNG" and got["photo.jpg"].file_format == "JPEG"
    assert got["sub/shot.dng"].preview[:2] == b"\xff\xd8" and got["sub/shot.dng"].preview[-2:] == b"\xff\xd9" and got["photo.jpg"].preview is None
    again = {r.item_id for r in files.scan(spark, tree).collect()}
    assert again == {r.item_id for r in got.values()}


def test_exif_scan(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(exif_jpeg())
    (tmp_path / "b.nef").write_bytes(b"nothing")
    got = {r.file_path[-5:]: r for r in files.scan(spark, str(tmp_path)).collect()}
    a, b = got["a.jpg"], got["b.nef"]
    assert a.camera_make == "Canon" and str(a.timestamp_utc) == "2024-06-01 10:20:30" and a.gps == pytest.approx([-35.51, -10.0])
    assert (b.camera_make, b.camera_model, b.error) == ("Nikon", "Nikon NEF", None)


def far_tiff():
    """A raw file whose directory stands behind 2 MB of pixels."""
    pixels = bytes(2 << 20)
    at = 8 + len(pixels)
    entry = lambda tag, kind, n, value: struct.pack("<HHII", tag, kind, n, value)
    heap = at + 2 + 12 * 2 + 4
    ifd = struct.pack("<H", 2) + entry(0x010F, 2, 6, heap) + entry(0x0132, 2, 20, heap + 6) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", at) + pixels + ifd + b"Nikon\0" + b"2023:02:03 04:05:06\0"


def test_directory_at_the_end_of_a_file(spark, tmp_path):
    (tmp_path / "far.nef").write_bytes(far_tiff())
    (tmp_path / "late.jpg").write_bytes(b"\xff\xd8" + (b"\xff\xe2" + struct.pack(">H", 65_000) + bytes(64_998)) * 9 + exif_jpeg()[2:])
    got = {r.file_path[-7:]: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert (got["far.nef"].camera_make, str(got["far.nef"].timestamp_utc)) == ("Nikon", "2023-02-03 04:05:06")
    assert got["ate.jpg"].camera_make == "Canon" and got["ate.jpg"].gps == pytest.approx([-35.51, -10.0])


def test_deep_listing_in_order(spark, tmp_path):
    want = []
    for k, folder in enumerate(("", "a", "a/b", "a/b/c", "z", ".shoebox_thumbs", "a/.shoebox_thumbs")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / f"p{k}.jpg").write_bytes(b"x" * k)
        if "thumbs" not in folder:
            want.append((str(tmp_path / folder / f"p{k}.jpg"), k))
    assert [tuple(r) for r in files.list_files(spark, str(tmp_path), ordered=True).collect()] == sorted(want)
    (tmp_path / "none").mkdir()
    assert files.list_files(spark, str(tmp_path / "none")).count() == 0


def test_missing_file_is_an_error_row(spark):
    rows = spark.createDataFrame([("/nowhere/x.jpg", 1)], files.FILES)
    r = files.read_metadata(rows).first()
    assert r.source == "none" and r.error
    assert files.embedded_previews(rows).first().preview is None


@pytest.mark.parametrize("data, want", [(b"", None), (b"no marker", None), (b"ab\xff\xd8cd\xff\xd9ef", b"\xff\xd8cd\xff\xd9"), (b"\xff\xd8open", b"\xff\xd8open")])
def test_marker(data, want):
    assert files.marker_preview(data) == want


@pytest.mark.parametrize("data", [b"", b"\xff\xd8", exif_jpeg()[:40], b"II*\0" + b"\xff" * 20, b"MM\0*\0\0\0\x08\0\x01"])
def test_damaged_exif(data):
    assert isinstance(exif.read(data), dict)


def test_images(spark, tree, tmp_path):
    rows = images.load(spark, files.list_files(spark, tree), str(tmp_path / "cache"), tree)
    got = {r.path[len(tree) + 1 :]: r for r in images.signals(rows).collect()}
    assert len(got) == 5 and all(r.error is None for r in got.values())
    assert got["sub/shot.dng"].p_hash == got["photo.jpg"].p_hash and 0 <= got["photo.jpg"].aesthetic_score <= 10
    assert np.linalg.norm(got["photo.jpg"].dinov2_vector) == pytest.approx(1)
    bad = tmp_path / "bad.dng"
    bad.write_bytes(b"nothing here")
    r = images.signals(images.load(spark, spark.createDataFrame([(str(bad),)], "path string"), str(tmp_path / "c2"))).first()
    assert r.error and r.p_hash is None


def test_image_functions():
    grey = np.full((20, 30, 3), 115, np.uint8)
    assert images.aesthetic(grey) == pytest.approx(10 * 0.2 * (1 - 2 * abs(115 / 255 - 0.45)), abs=0.01)
    noise = np.random.default_rng(1).integers(20, 230, (48, 64, 3)).astype(np.uint8)
    assert (images.phash(noise) ^ images.phash(noise + np.uint8(3))).bit_count() <= 1
    assert (images.phash(noise) ^ images.phash(noise[::-1])).bit_count() > 16
    assert images.to_rgb(1, 1, 3, bytes([1, 2, 3])).tolist() == [[[3, 2, 1]]]
    assert images.to_rgb(1, 1, 1, bytes([7])).tolist() == [[[7, 7, 7]]]


def test_phash_by_definition():
    x = np.random.default_rng(2).integers(0, 255, (32, 32, 3)).astype(np.uint8)
    grey = np.round(x @ images.LUMA)
    c = lambda u, k: np.cos(np.pi * u * (2 * k + 1) / 64)
    low = [[sum(grey[i, j] * c(u, i) * c(v, j) for i in range(32) for j in range(32)) for v in range(8)] for u in range(8)]
    bits = [b > np.median(low) for row in low for b in row]
    assert images.phash(x) == sum(1 << (63 - i) for i, b in enumerate(bits) if b)


class FakeModel:
    img_size = 28

    @staticmethod
    def features(x):
        assert x.shape[1:] == (3, 28, 28)
        return np.stack([x.mean(axis=(2, 3)) * 100, np.zeros((len(x), 3))], axis=1)


def test_encoder_falls_back_and_asks_for_the_size():
    tried = []

    def load(name, device):
        tried.append((name, device))
        if len(tried) == 1:
            raise OSError("no weights")
        return FakeModel

    encode = images.vit_encoder(load=load, device="cpu")()
    assert tried == [(n, "cpu") for n in images.ENCODERS]
    white = encode([np.full((40, 60, 3), 255, np.uint8), np.zeros((5, 9, 3), np.uint8)])
    want = (1 - images.COLOUR_MEAN) / images.COLOUR_DEVIATION
    assert white[0] == pytest.approx(want / np.linalg.norm(want)) and np.linalg.norm(white, axis=1) == pytest.approx(1)
    assert images.input_size(object()) == (518, 518) and images.input_size(FakeModel) == (28, 28)
    assert images.best_device("x") == "x" and images.best_device() in ("cpu", "mps", "cuda")

    def never(name, device):
        raise OSError(name)

    with pytest.raises(RuntimeError, match=images.ENCODERS[1]):
        images.vit_encoder(load=never)()


def test_passes_over_a_store(spark, tree, tmp_path):
    s = Store(spark, str(tmp_path / "lib"))
    for _ in range(2):  # scanning again changes nothing but the log
        rows = library.scan_directory(s, tree)
        assert rows.count() == 5 == s.count()
    assert [r.id for r in s.log().orderBy("id").collect()] == list(range(1, 11))
    results, stats = library.run_embeddings(s, str(tmp_path / "cache"), tree)
    assert tuple(stats.first()) == (5, 5, 0) and s.pending_embeddings().count() == 0 and results.where("item_id is null").count() == 0
    library.scan_directory(s, tree, log=False)
    assert s.pending_embeddings().count() == 0
    copies = [r for r in library.run_dedup(s).collect() if r.duplicate_group_id]
    assert {r.file_path[len(tree) + 1 :] for r in copies} >= {"photo.jpg", "sub/shot.dng"} and sum(r.is_primary_master for r in copies) == len({r.duplicate_group_id for r in copies})
    assert library.run_clustering(s).count() == 5


def test_shared_folder_is_asked_for_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://there:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session)


def test_stream(spark, tree, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    for _ in range(2):
        q = ingest.ingest(spark, tree, s, str(tmp_path / "cp"))
        q.awaitTermination(60)
        assert q.exception() is None
    assert sorted(r.file_format for r in s.items().collect()) == ["DNG", "JPEG", "JPEG"]
