"""Exact cosine nearest neighbours."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from shoebox.functions.vectors import dot, norm
from shoebox.plans.tables import Scratch


def nearest_neighbors(items: DataFrame, query: list[float], limit: int = 20, exclude: list[str] | DataFrame | None = None, id_col: str = "item_id", vector: str = "dinov2_vector") -> DataFrame:
    """(id, similarity) of the ``limit`` most similar vectors, ties by id. Zero vectors and vectors of
    another length are left out; a zero query gives no rows. ``exclude``: ids, or a table of them."""
    length = float(np.linalg.norm(query))
    rows = items.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == len(query))
    if isinstance(exclude, DataFrame):
        rows = rows.join(exclude.select(F.col(exclude.columns[0]).alias("id")), "id", "left_anti")
    elif exclude:
        rows = rows.where(~F.col("id").isin(*exclude))
    if not length:
        return rows.limit(0).select("id", F.lit(0.0).alias("similarity"))
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = rows.withColumn("n", norm("v")).where("n > 0")
    return rows.select("id", (dot("v", q) / (F.col("n") * length)).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(limit)


def knn_batch(items: DataFrame, queries: DataFrame, limit: int = 10, id_col: str = "item_id", vector: str = "dinov2_vector", block: int = 2_000) -> DataFrame:
    """(query_id, id, similarity, rank) of the ``limit`` most similar vectors of each query.

    Queries (query_id, vector) go in blocks of ``block``, the size of the broadcast; each scan keeps the best of
    a batch per query (matrix products), so ``limit`` rows per query and batch are shuffled. Results of all blocks but
    the last are written, a scan at a time. A query_id stands for one vector.
    """
    spark = items.sparkSession
    rows = items.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    id_type, q_type = (x.dataType.simpleString() for x in (rows.schema["id"], queries.schema["query_id"]))

    def scan(ids: list, vectors: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, vectors))

        def run(batches):
            names, q = shared.value
            for batch in batches:
                sizes = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
                part = batch.filter(pa.array(sizes == q.shape[1]))
                if not part.num_rows:
                    continue
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
                n = np.linalg.norm(x, axis=1)
                sim = np.where(n[None, :] > 0, (q @ x.T) / np.where(n > 0, n, 1)[None, :], -np.inf)
                k = min(limit, sim.shape[1])
                if k < sim.shape[1]:
                    # keep all that tie with the k-th, so that ties are settled by id at the end
                    kth = np.partition(sim, -k, axis=1)[:, -k]
                    qi, at = np.nonzero((sim >= kth[:, None]) & np.isfinite(sim))
                else:
                    qi, at = np.nonzero(np.isfinite(sim))
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in qi.tolist()]), part.column("id").take(pa.array(at)), pa.array(sim[qi, at])], ["query_id", "id", "similarity"])

        return rows.mapInArrow(run, f"query_id {q_type}, id {id_type}, similarity double")

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    scratch, blocks, ids, vectors = Scratch(spark, "neighbours"), [], [], []

    def best() -> DataFrame:
        q = np.array(vectors)
        length = np.linalg.norm(q, axis=1)
        found = scan([i for i, n in zip(ids, length) if n], q[length > 0] / length[length > 0][:, None])
        return found.withColumn("rank", rank).where(F.col("rank") <= limit)

    wanted = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    for row in wanted.orderBy(F.size("vector"), "query_id").toLocalIterator():
        if vectors and (len(ids) == block or len(row["vector"]) != len(vectors[0])):
            blocks.append(scratch.write(best()))
            ids, vectors = [], []
        ids.append(row["query_id"])
        vectors.append(row["vector"])
    if not ids:
        return spark.createDataFrame([], f"query_id {q_type}, id {id_type}, similarity double, rank int")
    return functools.reduce(DataFrame.unionByName, [*blocks, best()])
