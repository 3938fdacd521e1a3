"""Visual similarity: pairs within a cosine distance, and their components.

Vectors are dealt to the nearest of some pivot vectors (``PIVOTS`` at most, a bounded sample of the table).
By the triangle inequality of angles, two cells can only hold a pair if their pivots are no further apart than
both radii and the threshold; other pairs of cells are never compared. Cells are cut into blocks, and a task
compares two blocks by matrix products, so memory is bounded by the block size. Exact for any data; nearly
orthogonal vectors, which no lossless rule can tell apart, cost all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shoebox.plans.components import connected_components
from shoebox.plans.tables import Scratch

EPSILON, BLOCK, PIVOTS = 0.05, 4_096, 256


def _cells(c: DataFrame, scratch: Scratch, block: int, pivots: int) -> tuple[DataFrame, np.ndarray, dict]:
    """The rows of (rep, v) with their cell and angle, the pivots' angles, and (rows, radius) by cell."""
    n = c.count()
    chosen = c.orderBy(F.xxhash64("rep"), "rep").limit(max(1, min(pivots, -(-n // block)))).select("v").collect()
    by_size: dict[int, list[np.ndarray]] = {}
    for r in chosen:
        by_size.setdefault(len(r["v"]), []).append(np.array(r["v"]) / np.linalg.norm(r["v"]))
    first = {k: sum(len(x) for j, x in by_size.items() if j < k) for k in by_size}
    shared = c.sparkSession.sparkContext.broadcast({k: np.array(x) for k, x in by_size.items()})
    rest = sum(map(len, by_size.values()))  # the cell of lengths that no pivot has: compared with itself alone

    def deal(batches):
        table = shared.value
        for batch in batches:
            cell, angle = [], []
            for v in batch.column("v").to_pylist():
                if len(v) in table:
                    cos = np.clip(table[len(v)] @ v / np.linalg.norm(v), -1, 1)
                    at = int(cos.argmax())
                    cell.append(first[len(v)] + at)
                    angle.append(float(np.arccos(cos[at])))
                else:
                    cell.append(rest)
                    angle.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(angle, pa.float64())], ["rep", "v", "cell", "angle"])

    placed = scratch.write(c.mapInArrow(deal, "rep string, v array<double>, cell int, angle double"))
    apart = np.full((rest + 1, rest + 1), np.inf)
    for k, x in by_size.items():
        m = np.array(x)
        s = slice(first[k], first[k] + len(m))
        apart[s, s] = np.arccos(np.clip(m @ m.T, -1, 1))
    np.fill_diagonal(apart, 0)
    stats = {r["cell"]: (r["n"], r["radius"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    return placed, apart, stats


def _class_edges(c: DataFrame, epsilon: float, block: int, scratch: Scratch, pivots: int = PIVOTS) -> DataFrame:
    """(x, y, distance) with x < y over classes (rep, v) without zero vectors."""
    placed, apart, stats = _cells(c, scratch, block, pivots)
    reach = float(np.arccos(max(-1.0, 1 - epsilon))) + 1e-6
    parts = {cell: -(-n // block) for cell, (n, _) in stats.items()}
    start, at = {}, 0
    for cell, k in sorted(parts.items()):
        start[cell], at = at, at + k
    partners = [(i, start[j], parts[j]) for i in parts for j in parts if i == j or apart[i, j] <= stats[i][1] + stats[j][1] + reach]
    spark = c.sparkSession
    own = spark.createDataFrame([(i, start[i], parts[i]) for i in parts], "cell int, _start int, _parts int")
    near = spark.createDataFrame(partners, "cell int, _from int, _n int")
    blocked = placed.join(F.broadcast(own), "cell").withColumn("b", (F.col("_start") + F.pmod(F.xxhash64("rep"), F.col("_parts"))).cast("int"))
    spread = blocked.join(F.broadcast(near), "cell").select("rep", "v", "b", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("_n") - 1)).alias("o"))
    spread = spread.select("rep", "v", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        out = []
        for size, part in pdf.groupby(pdf["v"].map(len)):
            left, right = part[part["b"] == i], part[part["b"] == j]
            if not size or not len(left) or not len(right):
                continue
            a, b = (np.vstack(x["v"].to_numpy()) for x in (left, right))
            unit = [x / np.where((n := np.linalg.norm(x, axis=1)) > 0, n, 1)[:, None] for x in (a, b)]
            names = left["rep"].to_numpy(), right["rep"].to_numpy()
            for s in range(0, len(a), 512):
                far = 1 - unit[0][s : s + 512] @ unit[1].T
                r, q = np.nonzero(far <= epsilon)
                x, y = names[0][r + s], names[1][q]
                keep = x < y if i == j else np.ones(len(x), bool)
                out.append(pd.DataFrame({"x": np.minimum(x, y)[keep] if i != j else x[keep], "y": np.maximum(x, y)[keep] if i != j else y[keep], "distance": far[r, q][keep]}))
        return pd.concat(out) if out else pd.DataFrame({"x": [], "y": [], "distance": []})

    return spread.groupBy("i", "j").applyInPandas(compare, "x string, y string, distance double")


def _zero(v: str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) == 0


def visual_edges(items: DataFrame, epsilon: float = EPSILON, block: int = BLOCK, id_col: str = "item_id", vector: str = "dinov2_vector") -> DataFrame:
    """(id_a, id_b, distance) of every two vectors at most ``epsilon`` apart in cosine distance. Nulls,
    zero vectors and other lengths link nothing."""
    scratch = Scratch(items.sparkSession, "visual")
    rows = items.select(F.col(id_col).alias("rep"), F.col(vector).alias("v")).where("v is not null").where(~_zero("v"))
    return _class_edges(rows, epsilon, block, scratch).select(F.col("x").alias("id_a"), F.col("y").alias("id_b"), "distance")


def visual_components(items: DataFrame, epsilon: float = EPSILON, block: int = BLOCK, id_col: str = "item_id", vector: str = "dinov2_vector") -> DataFrame:
    """(item_id, component) of every item with a vector, singletons included; component is the
    least member id."""
    scratch = Scratch(items.sparkSession, "visual")
    rows = items.select(F.col(id_col).alias("item_id"), F.col(vector).alias("v")).where("v is not null")
    zero = _zero("v")
    c = scratch.write(rows.where(~zero).groupBy("v").agg(F.min("item_id").alias("rep")))
    edges = _class_edges(c, epsilon, block, scratch).select(F.col("x").alias("src"), F.col("y").alias("dst"))
    found = connected_components(edges, scratch)
    named = c.join(found, c.rep == found.node, "left").select("v", F.coalesce("component", "rep").alias("component"))
    alone = rows.where(zero).select("item_id", F.col("item_id").alias("component"))
    return rows.join(named, "v").select("item_id", "component").unionByName(alone)
