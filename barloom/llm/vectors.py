"""Vectors of a table: which take part, and centroids fitted on a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, ok, values (doubles, packed; null unless ok), dim, k1, k2 (hashes of the values) of ``rows`` (vec_id, embedding).

    A vector takes part if it is not null or zero and all its components are finite.
    """
    v = F.col("embedding").cast("array<double>")
    ok = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    # -0.0 + 0.0 is 0.0, so equal vectors have equal hashes
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(ok, F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))

    def pack(batches):
        for b in batches:
            v = b["v"]
            flat, at = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays(
                [b["vec_id"], v.is_valid(), pa.array([flat[i:j].tobytes() if good else None for i, j, good in zip(at[:-1], at[1:], v.is_valid().to_pylist())], pa.binary()),
                 pa.array(np.diff(at).astype(np.int32)), b["k1"], b["k2"]], names=["vec_id", "ok", "values", "dim", "k1", "k2"])

    return rows.select("vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(7), "v").alias("k2")) \
        .mapInArrow(pack, "vec_id long, ok boolean, values binary, dim int, k1 long, k2 long")


def matrix(packed, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(-1, dim)


def sample_of(vectors: DataFrame, size: int = SAMPLE) -> tuple[int, np.ndarray]:
    """(dimension, at most ``size`` vectors): those of the smallest hash, of the dimension most of them have."""
    rows = vectors.where("ok").select("k1", "k2", "dim", "values").orderBy("k1", "k2").limit(size).toArrow()
    dims = np.asarray(rows["dim"])
    dim = int(np.bincount(dims).argmax()) if len(dims) else 0
    return dim, matrix([v for v, d in zip(rows["values"].to_pylist(), dims) if d == dim], dim) if dim else np.zeros((0, 0))


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids ** 2).sum(1) - 2 * points @ centroids.T).argmin(1)


def k_means(points: np.ndarray, k: int, rounds: int = 10, spherical: bool = False, seed: int = 5) -> np.ndarray:
    """At most ``k`` centroids; of length 1 if ``spherical``."""
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centroids = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        mine = nearest(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, mine, points)
        count = np.bincount(mine, minlength=len(centroids))
        centroids[count > 0] = sums[count > 0] / count[count > 0, None]
        if spherical:
            length = np.linalg.norm(centroids, axis=1)
            centroids[length > 0] /= length[length > 0, None]
    return centroids
