"""Near-duplicate vectors: spherical k-means cells, cosines within a cell block by block, one kept per group.

Equal vectors are one class, with a count.  A class goes to the cell of its nearest centroid; near a border to
lower neighbours as well, up to ``reach`` times what a link of the least cosine spans across a border when its
direction is random (a link lies 1 / sqrt(dimension) of its length across, so 3 leaves few out; measured in
the tests).  A cell's own classes and its guests are cut by hash into blocks of about ``block`` classes, and each pair of
blocks, one of them at home, is one task that multiplies two matrices of doubles; a pair of classes meets in one
task.  A task returns a count
for each class and one link for each class to hold a component together, never its pairs.

Nulls: vectors that are null, zero or hold null or non-finite components have no links and are kept, unless
vec_id is null.  Vectors of different lengths never link; the cells serve the commonest length, others have one
cell a length.  Rows that share a vec_id each count.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import components
from .shared import cut
from .vectors import k_means, matrix, sample_of, usable


def in_cells(classes: DataFrame, dim: int, centroids: np.ndarray, least: float, reach: float) -> DataFrame:
    """Rows of classes (node, dim, values, n) with ``cell`` and ``home``: one at home, others as guests of lower cells."""
    apart = np.linalg.norm(centroids[:, None] - centroids[None], axis=2) if len(centroids) else np.zeros((0, 0))
    margin = reach * np.sqrt(2 - 2 * least) / np.sqrt(max(dim, 1))

    def deal(batches):
        for b in batches:
            dims = b["dim"].to_numpy()
            own = np.flatnonzero(dims == dim)
            row, cell, home = [np.flatnonzero(dims != dim)], [np.zeros((dims != dim).sum(), np.int64)], [np.ones((dims != dim).sum(), bool)]
            if len(own):
                v = matrix(b["values"].take(pa.array(own)).to_pylist(), dim)
                near = v / np.linalg.norm(v, axis=1, keepdims=True) @ centroids.T
                mine = near.argmax(1)
                guest = near[np.arange(len(own)), mine][:, None] - near <= margin * apart[mine]
                guest &= np.arange(len(centroids)) < mine[:, None]
                i, c = np.nonzero(guest)
                row += [own, own[i]]
                cell += [mine, c]
                home += [np.ones(len(own), bool), np.zeros(len(i), bool)]
            row, cell, home = np.concatenate(row), np.concatenate(cell), np.concatenate(home)
            for k in range(0, len(row), 4096):
                part = b.take(pa.array(row[k:k + 4096]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell[k:k + 4096]), pa.array(home[k:k + 4096])], names=[*b.schema.names, "cell", "home"])

    return classes.mapInArrow(deal, "node long, dim int, values binary, n long, cell long, home boolean")


def compare(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """node, links, other: what a task's pairs add to each class, and one class it hangs together with."""
    first = pdf[pdf["side"] != 1]
    second = pdf[pdf["side"] != 0]
    same = bool((pdf["side"] == 2).any())                      # a block with itself
    dim = int(pdf["dim"].iloc[0])
    a, b = (matrix(x["values"].tolist(), dim) if len(x) else np.zeros((0, dim)) for x in (first, second))
    a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
    near = a @ b.T >= least
    near &= first["home"].to_numpy(bool)[:, None] | second["home"].to_numpy(bool)[None]
    if same:
        near |= near.T
        np.fill_diagonal(near, False)
    links = np.concatenate([near @ second["n"].to_numpy(np.int64), np.zeros(0, np.int64) if same else near.T @ first["n"].to_numpy(np.int64)])
    nodes = np.concatenate([first["node"].to_numpy(), np.zeros(0, np.int64) if same else second["node"].to_numpy()])
    left, right = first["node"].to_numpy(), second["node"].to_numpy()
    far = np.iinfo(np.int64).max
    x, y = left.copy(), right.copy()
    while True:                                                 # the smallest node spreads over the links of this task
        new_x = np.minimum(x, np.where(near, y[None], far).min(1, initial=far))
        new_y = new_x if same else np.minimum(y, np.where(near, new_x[:, None], far).min(0, initial=far))
        if np.array_equal(new_x, x) and np.array_equal(new_y, y):
            break
        x, y = new_x, new_y
    out = pd.DataFrame({"node": nodes, "links": links, "other": np.concatenate([x, y[:0] if same else y])})
    return out[out["links"] > 0]


def near_duplicates(rows: DataFrame, least: float = 0.9, cell_rows: int = 2000, most_cells: int = 4096, reach: float = 3.0, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``rows`` (vec_id, embedding)."""
    vectors = cut(usable(rows))
    good = vectors.where("ok")
    ids = good.groupBy("k1", "k2", "dim").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id"), F.min("values").alias("values"))
    # a class's number: a hash of its key; equal numbers would have to share 64 bits
    classes = cut(ids.withColumn("node", F.xxhash64("k1", "k2", "dim")))
    dim, sample = sample_of(vectors)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True) if len(sample) else sample
    k = int(min(most_cells, max(1, classes.count() // cell_rows)))
    centroids = k_means(unit, k, spherical=True) if len(unit) else np.zeros((0, dim))
    dealt = in_cells(classes.select("node", "dim", "values", "n"), dim, centroids, least, reach)
    blocks = lambda rows: F.ceil(F.count(F.when(rows, True)) / block)
    counts = dealt.groupBy("dim", "cell").agg(blocks(F.col("home")).alias("own"), blocks(~F.col("home")).alias("guests")).where("own > 0")
    hashed = F.xxhash64("node")
    dealt = dealt.join(counts, ["dim", "cell"]).withColumn("i", F.when(F.col("home"), F.pmod(hashed, F.col("own"))).otherwise(
        F.col("own") + F.pmod(hashed, F.greatest("guests", F.lit(1)))))
    # Block pair (i, j), i <= j: side 0 is i, side 1 is j, side 2 is both.  Blocks of guests meet those at home only.
    others = F.when(F.col("home"), F.col("own") + F.col("guests")).otherwise(F.col("own"))
    paired = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), others - 1))).select(
        "dim", "cell", F.least("i", "o").alias("bi"), F.greatest("i", "o").alias("bj"),
        F.when(F.col("i") == F.col("o"), 2).when(F.col("i") < F.col("o"), 0).otherwise(1).alias("side"), "node", "values", "n", "home")
    found = cut(paired.groupBy("dim", "cell", "bi", "bj").applyInPandas(lambda p: compare(p, least), "node long, links long, other long"))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.join(sums, "node", "left").join(parts, "node", "left").select(
        "node", "k1", "k2", "dim", "least_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("whole"))
    least_ids = named.groupBy("whole").agg(F.min("least_id").alias("component_id"))
    named = named.join(least_ids, "whole").select("k1", "k2", "dim", "n_links", "component_id")
    linked = good.select("vec_id", "k1", "k2", "dim").join(named, ["k1", "k2", "dim"]).select("vec_id", "n_links", "component_id")
    alone = vectors.where("NOT ok").select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
