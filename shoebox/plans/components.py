"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations with map-side combine and two equi-joins on node ids; no group is
collected, so a hub with a third of all edges costs partial minima and a join that AQE can split.
The edge table is written to the shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shoebox.plans.tables import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b. Large: every larger neighbour of u goes to u's least neighbour.
    Small: u and its smaller neighbours go to the least of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge; component is the least node reachable.

    Nodes without edges, edges with a null end and self-loops give no rows; repeated edges count
    once. Stops when a round changes nothing; raises after ``max_rounds``.
    """
    a, b = F.col(src), F.col(dst)
    cur = scratch.write(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    )
    state = None
    for _ in range(max_rounds):
        new = scratch.write(_star(_star(cur, True), False))
        scratch.drop(cur)
        cur = new
        digest = cur.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if tuple(digest) == state:
            least = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(least)
        state = tuple(digest)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
