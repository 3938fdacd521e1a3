"""Event clustering: the day walk, visual components of what it leaves, chunks and numbering.

The walk is sequential by definition: whether a photo joins depends on the body that opened the
current event and on the positions of its members. Rows are partitioned by day, sorted, and
streamed: a task holds the current event's distinct positions, never a day, in cubes of the distance, so that a photo is
compared with those of its neighbourhood.
"""

from __future__ import annotations

import itertools
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shoebox.functions.scalar import EARTH_RADIUS_M, body_signature, event_title, time_key
from shoebox.operators.dedup import number_rows
from shoebox.operators.visual import EPSILON, visual_components
from shoebox.plans.tables import Scratch

GAP_MINUTES, METERS, MIN_COUNT, MAX_MEMBERS = 30, 50.0, 2, 10_000


def keyed(items: DataFrame) -> DataFrame:
    """``items`` with ``day`` and ``body``."""
    return items.withColumn("day", time_key()).withColumn("body", body_signature())


def items_by_day(items: DataFrame) -> DataFrame:
    """(day, n, first_id, last_id): photos of each day; ``?`` is the day of those without one."""
    return keyed(items).groupBy("day").agg(F.count("*").alias("n"), F.min("item_id").alias("first_id"), F.max("item_id").alias("last_id"))


class Walk:
    """State of the walk over one day's photos in order; ``step`` gives the photo's event number."""

    def __init__(self, gap_minutes: float = GAP_MINUTES, meters: float = METERS):
        self.gap, self.meters = gap_minutes * 60e6, meters
        self.day, self.event = None, -1

    def cell(self, lat: float, lon: float) -> tuple[int, int, int]:
        """The cube of ``meters`` that a position is in; positions within ``meters`` are in neighbouring cubes."""
        a, b, size = math.radians(lat), math.radians(lon), max(self.meters, 1.0) * (1 + 1e-6) / EARTH_RADIUS_M
        return math.floor(math.cos(a) * math.cos(b) / size), math.floor(math.cos(a) * math.sin(b) / size), math.floor(math.sin(a) / size)

    def near(self, lat: float, lon: float) -> bool:
        if not self.points or not (math.isfinite(lat) and math.isfinite(lon)):
            return False
        if (lat, lon) in self.points:
            return True
        x, y, z = self.cell(lat, lon)
        a, b = math.radians(lat), math.radians(lon)
        for at in itertools.product((x - 1, x, x + 1), (y - 1, y, y + 1), (z - 1, z, z + 1)):
            for p, q in self.cells.get(at, ()):
                h = math.sin((a - p) / 2) ** 2 + math.cos(a) * math.cos(p) * math.sin((b - q) / 2) ** 2
                if 2 * EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h))) <= self.meters:
                    return True
        return False

    def add(self, lat: float, lon: float) -> None:
        if (lat, lon) not in self.points and math.isfinite(lat) and math.isfinite(lon):
            self.points.add((lat, lon))
            self.cells.setdefault(self.cell(lat, lon), []).append((math.radians(lat), math.radians(lon)))

    def step(self, day, ts, body, gps) -> int:
        """``ts`` in microseconds or null; ``gps`` a pair or null."""
        has = gps is not None and len(gps) >= 2 and gps[0] is not None and gps[1] is not None
        if day != self.day:
            self.day, self.event, opens = day, 0, True
        elif body == self.body:
            opens = False
        else:
            close = ts is None or self.last is None or ts - self.last <= self.gap
            opens = not (close and has and self.near(gps[0], gps[1]))
            self.event += opens
        if opens:
            self.body, self.last, self.points, self.cells = body, None, set(), {}
        if ts is not None:
            self.last = ts
        if has:
            self.add(gps[0], gps[1])
        return self.event


def day_events(items: DataFrame, gap_minutes: float = GAP_MINUTES, meters: float = METERS) -> DataFrame:
    """(item_id, day, ts, seq): the number of each dated photo's event within its day, from 0."""
    rows = keyed(items).where("day <> '?'").select("item_id", "day", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', timestamp_utc)").alias("us"), "timestamp_utc", "body", "gps")
    rows = rows.repartition("day").sortWithinPartitions("day", F.col("us").asc_nulls_first(), "item_id")

    def run(batches):
        walk = Walk(gap_minutes, meters)
        for batch in batches:
            seq = [walk.step(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("day", "us", "body", "gps")))]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("day"), batch.column("timestamp_utc"), pa.array(seq, pa.int64())], ["item_id", "day", "ts", "seq"])

    return rows.mapInArrow(run, "item_id string, day string, ts timestamp_ntz, seq long")


def day_islands(items: DataFrame, peer: Column | None = None) -> DataFrame:
    """(item_id, day, island): the walk without positions, as gaps and islands of the body. Rows of equal time and ``peer``
    (a beginning of the id; the id itself if not given) share the island of their last."""
    peers = W.partitionBy("day").orderBy(F.col("timestamp_utc").asc_nulls_first(), F.col("item_id") if peer is None else peer)
    order = W.partitionBy("day").orderBy(F.col("timestamp_utc").asc_nulls_first(), "item_id")
    rows = keyed(items).where("day <> '?'").select("item_id", "day", "body", "timestamp_utc")
    change = F.when(F.lag("body").over(order) != F.col("body"), 1).otherwise(0)
    return rows.withColumn("c", change).select("item_id", "day", F.sum("c").over(peers).alias("island"))


def body_split(items: DataFrame, gap_minutes: float = GAP_MINUTES, peer: Column | None = None) -> DataFrame:
    """(item_id, day, part): a new part where the body changes after a gap; a missing time counts as one. ``peer`` as in ``day_islands``."""
    peers = W.partitionBy("day").orderBy(F.col("timestamp_utc").asc_nulls_last(), F.col("item_id") if peer is None else peer)
    order = W.partitionBy("day").orderBy(F.col("timestamp_utc").asc_nulls_last(), "item_id")
    rows = keyed(items).where("day <> '?'").select("item_id", "day", "body", "timestamp_utc")
    last = F.last("timestamp_utc", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_last", last).withColumn("_body", F.lag("body").over(order))
    gap = F.col("timestamp_utc").isNull() | F.col("_last").isNull() | (F.expr("timestampdiff(MICROSECOND, _last, timestamp_utc)") > int(gap_minutes * 60e6))
    rows = rows.withColumn("_c", F.when((F.col("_body") != F.col("body")) & gap, 1).otherwise(0))
    return rows.select("item_id", "day", F.sum("_c").over(peers).alias("part"))


def chunks(members: DataFrame, keys: list[str], max_members: int = MAX_MEMBERS) -> DataFrame:
    """``members`` (keys, item_id, ts) with ``chunk``: runs of ``max_members`` in time order."""
    order = W.partitionBy(*keys).orderBy(F.col("ts").asc_nulls_first(), "item_id")
    return members.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / max_members))


def members(
    items: DataFrame, min_count: int = MIN_COUNT, max_members: int = MAX_MEMBERS, gap_minutes: float = GAP_MINUTES, meters: float = METERS, epsilon: float = EPSILON
) -> DataFrame:
    """(item_id, event_id, seq, size, title, anchored_by_visual), a row per photo in an event: day events, then visual
    components of photos without time and position that are in none."""
    scratch = Scratch(items.sparkSession, "events")
    walked = scratch.write(day_events(items, gap_minutes, meters))
    enough = walked.groupBy("day", "seq").agg(F.count("*").alias("n")).where(F.col("n") >= min_count).select("day", "seq")
    dated = scratch.write(walked.join(enough, ["day", "seq"]))
    left = unassigned_visual(items, dated)
    seen = visual_components(left, epsilon).join(left.select("item_id", F.col("timestamp_utc").alias("ts")), "item_id")
    big = seen.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= min_count).select("component")
    visual = seen.join(big, "component")
    both = dated.select(F.lit(0).alias("phase"), "day", F.col("seq"), F.lit("").alias("component"), "item_id", "ts").unionByName(
        visual.select(F.lit(1).alias("phase"), F.lit("").alias("day"), F.lit(0).cast("long").alias("seq"), "component", "item_id", "ts")
    )
    keys = ["phase", "day", "seq", "component", "chunk"]
    cut = scratch.write(chunks(both, keys[:-1], max_members).join(items.select("item_id", time_key().alias("own_day")), "item_id"))
    events = cut.groupBy(*keys).agg(F.count("*").cast("int").alias("size"), F.coalesce(F.min(F.when(F.col("own_day") != "?", F.col("own_day"))), F.lit("?")).alias("first_day"))
    numbered = number_rows(events, [F.col(c).asc() for c in keys], "number")
    joined = cut.select("item_id", *keys).join(numbered, keys)
    return joined.select("item_id", F.format_string("event-%04d", "number").alias("event_id"), F.col("number").alias("seq"), "size", event_title("first_day").alias("title"), (F.col("phase") == 1).alias("anchored_by_visual"))


def cluster(
    items: DataFrame, min_count: int = MIN_COUNT, max_members: int = MAX_MEMBERS, gap_minutes: float = GAP_MINUTES, meters: float = METERS, epsilon: float = EPSILON, max_span_hours: float | None = None
) -> DataFrame:
    """(event_id, seq, item_ids, size, title, anchored_by_visual): ``members`` as one row per event, of ``max_members`` photos
    at most. ``max_span_hours`` splits nothing within a day and may be left out."""
    rows = members(items, min_count, max_members, gap_minutes, meters, epsilon)
    return rows.groupBy("event_id", "seq", "size", "title", "anchored_by_visual").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids")).select("event_id", "seq", "item_ids", "size", "title", "anchored_by_visual")


def run_clustering(items: DataFrame, keep_stale: bool = False, **options) -> DataFrame:
    """``items`` with their events assigned, photo by photo; no list is made."""
    return assign(items, members(items, **options), keep_stale)


def unassigned_visual(items: DataFrame, assigned: DataFrame) -> DataFrame:
    """Photos of the visual pass: without position, with no time of their own, in no event of
    ``assigned`` (item_id)."""
    return items.where("timestamp_utc is null and gps is null").join(assigned.select("item_id"), "item_id", "left_anti")


def assign(items: DataFrame, events: DataFrame, keep_stale: bool = False) -> DataFrame:
    """``items`` with event_id of ``events`` (event_id, item_id or item_ids); others are cleared unless ``keep_stale``."""
    one = F.col("item_id") if "item_id" in events.columns else F.explode("item_ids").alias("item_id")
    at = events.select(F.col("event_id").alias("_event"), one)
    event = F.coalesce("_event", "event_id") if keep_stale else F.col("_event")
    return items.join(at, "item_id", "left").withColumn("event_id", event).select(*items.columns)
