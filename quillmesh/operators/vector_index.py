"""An inverted-file index of vectors: every row under its nearest center, searches in the nearest few lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.ranking import _unit

#: Rows that centers are fitted on, by the hash of their id.
SAMPLE = 20_000


def fit_centers(rows: DataFrame, lists: int, row_id: str = "vec_id", vector: str = "embedding", rounds: int = 12) -> np.ndarray:
    """Centers of ``lists`` clusters (unit vectors), by k-means over at most SAMPLE rows; the same for the same rows."""
    n = rows.count()
    part = rows.where(F.col(vector).isNotNull()).where(F.pmod(F.xxhash64(row_id), F.lit(1_000_003)) < 1_000_003 * min(1.0, SAMPLE / max(n, 1)))
    v = _unit(part.select(vector).limit(2 * SAMPLE).toArrow().column(0).to_pylist())
    v = v[np.linalg.norm(v, axis=1) > 0] if len(v) else v
    if not len(v):
        return np.zeros((0, 0))
    rng = np.random.default_rng(7)
    order = np.lexsort(v.T)  # the order of rows means nothing
    v = v[order]
    centers = v[rng.choice(len(v), min(lists, len(v)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(v @ centers.T, axis=1)
        for c in range(len(centers)):
            own = v[near == c]
            if len(own):
                m = own.sum(0)
                centers[c] = m / max(np.linalg.norm(m), 1e-12)
    return centers


def assign(rows: DataFrame, centers: np.ndarray, id_column: str, vector: str, nearest: int = 1) -> DataFrame:
    """id, list and vector: each row under its nearest centers. Null and zero vectors go to list 0, so that none is lost."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(centers)  # lists times dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            v = _unit(b.column("v").to_pylist(), c.shape[1])
            k = min(nearest, len(c))
            near = np.argpartition(-(v @ c.T), k - 1, axis=1)[:, :k] if k < len(c) else np.broadcast_to(np.arange(len(c)), (len(v), len(c)))
            near = np.where((np.linalg.norm(v, axis=1) > 0)[:, None], near, 0)
            at = pa.array(np.repeat(np.arange(len(v)), k))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(v) + 1) * c.shape[1], c.shape[1], dtype=np.int32)), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), pa.array(near.ravel().astype(np.int32)), flat.take(at)], names=["id", "list", "unit"])

    return rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(run, "id long, list int, unit array<double>")


def search(queries: DataFrame, index: DataFrame, centers: np.ndarray, k: int, probes: int, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """The k indexed rows nearest to each query among its ``probes`` nearest lists: query_id, id, score, rank.

    Queries and rows meet by an equi-join on the list; AQE splits lists that are large.
    """
    q = assign(queries, centers, query_id, vector, probes).select(F.col("id").alias("query_id"), "list", F.col("unit").alias("q")).distinct()
    score = F.aggregate(F.zip_with("q", "unit", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    hits = q.join(index, "list").select("query_id", "id", F.round(score, 12).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
