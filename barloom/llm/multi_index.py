"""Inverted multi-index: nearest vectors by inner product.

Each half of a vector is quantised by a codebook of its own; an entry's cell is its pair of codes.  A query
visits pairs in falling order of the summed inner products of its halves with the centroids (the distance is
what a centroid lacks to the best one, and the sums come off a heap), until ``share`` of all entries are
visited and at least ``k`` of them.  Entries visited are scored on the original vectors in double precision,
in blocks of cells against chunks of queries, each keeping its best ``k``; the best of those remain.

All entries are indexed.  ``share`` is the feature's limit: what recall it gives was measured against brute
force (README); 1 is exact.

Vectors that are null, zero or hold null or non-finite components, or have another length than most, take no
part, nor do rows of null vec_id.  Ties go to the smaller vec_id; of rows that share a vec_id all take part.
Fewer candidates give fewer rows, an empty table none.  Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .vectors import k_means, matrix, nearest, sample_of, usable


def visited_cells(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> np.ndarray:
    """Flags of the cells (code pairs) that a query visits, given what its halves lack to their best centroids."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    seen, total = np.zeros(counts.shape, bool), 0
    heap = [(x[0] + y[0], 0, 0)]
    while heap and total < wanted:
        _, i, j = heapq.heappop(heap)
        seen[a[i], b[j]] = True
        total += counts[a[i], b[j]]
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):                      # each pair comes from one other pair
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return seen


def products(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the components, so equal vectors have equal scores."""
    out = np.zeros((len(queries), len(entries)))
    for d in range(queries.shape[1]):
        out += queries[:, d, None] * entries[None, :, d]
    return out


def best_of(pdf: pd.DataFrame, dim: int, k: int) -> pd.DataFrame:
    """A block's entries against a chunk of queries."""
    entries, queries = pdf[~pdf["query"]], pdf[pdf["query"]]
    if not len(entries) or not len(queries):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
    e = matrix(entries["values"].tolist(), dim)
    longest = np.linalg.norm(e, axis=1).max()
    e_id, e_cell = entries["vec_id"].to_numpy(np.int64), entries["cell"].to_numpy(np.int64)
    out = []
    for at in range(0, len(queries), 128):
        part = queries.iloc[at:at + 128]
        asked = matrix(part["values"].tolist(), dim)
        slack = 1e-12 * np.linalg.norm(asked, axis=1) * longest      # more than a matrix product's rounding
        for v, row, near, q, flags in zip(asked, asked @ e.T, slack, part["vec_id"].tolist(), part["cells"].tolist()):
            open_ = np.unpackbits(np.frombuffer(flags, np.uint8))[e_cell].astype(bool) & (e_id != q)
            i = np.flatnonzero(open_)
            if len(i) > k:
                i = i[row[i] >= np.partition(row[i], len(i) - k)[len(i) - k] - near]
            score = products(v[None], e[i])[0]
            best = np.lexsort((e_id[i], -score))[:k]
            out.append((np.full(len(best), q), e_id[i][best], score[best]))
    return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*out))})


def search(rows: DataFrame, is_query, k: int = 20, codes: int = 64, share: float = 0.5, block: int = 4096, chunk: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row where ``is_query`` (a column of vec_id) holds."""
    vectors = cut(usable(rows.where("vec_id IS NOT NULL")))
    dim, sample = sample_of(vectors)
    half = max(1, dim // 2)
    books = [k_means(x, codes) if x.size else np.zeros((1, x.shape[1])) for x in (sample[:, :half], sample[:, half:])] if dim else [np.zeros((1, 1))] * 2
    size = (len(books[0]), len(books[1]))
    good = vectors.where(F.col("ok") & (F.col("dim") == dim))

    def assign(batches):
        for b in batches:
            v = matrix(b["values"].to_pylist(), dim)
            cell = nearest(v[:, :half], books[0]) * size[1] + (nearest(v[:, half:], books[1]) if dim > half else 0)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["values"], pa.array(cell.astype(np.int64))], names=["vec_id", "values", "cell"])

    entries = cut(good.select("vec_id", "values").mapInArrow(assign, "vec_id long, values binary, cell long"))
    counts = np.zeros(size[0] * size[1], np.int64)
    for cell, n in entries.groupBy("cell").count().collect():              # a row a pair of codes
        counts[cell] = n
    total = int(counts.sum())
    # neighbouring cells share a block; a cell of several blocks' size is dealt over them by hash
    before = np.cumsum(counts) - counts
    first, last = before // block, (before + np.maximum(counts, 1) - 1) // block
    n_blocks = int(last.max()) + 1 if total else 1
    touches = np.zeros((n_blocks, len(counts)), bool)
    for c in np.flatnonzero(counts):
        touches[first[c]:last[c] + 1, c] = True
    wanted = max(int(np.ceil(share * total)), k + 1)

    def place(batches):
        for b in batches:
            cell = b["cell"].to_numpy()
            spread = b["spread"].to_numpy() % (last - first + 1)[cell]
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["values"], b["cell"], pa.array(first[cell] + spread)], names=["vec_id", "values", "cell", "block"])

    def route(batches):
        for b in batches:
            v = matrix(b["values"].to_pylist(), dim)
            flags, row, to = [], [], []
            for i, q in enumerate(v):
                lack = [s.max() - s for s in (q[:half] @ books[0].T, q[half:] @ books[1].T if dim > half else np.zeros(1))]
                seen = visited_cells(*lack, counts.reshape(size), wanted).ravel()
                flags.append(np.packbits(seen).tobytes())
                blocks = np.flatnonzero((touches & seen).any(1))
                row += [i] * len(blocks)
                to += blocks.tolist()
            for j in range(0, len(row), 4096):
                r = row[j:j + 4096]
                yield pa.RecordBatch.from_arrays([b["vec_id"].take(pa.array(r, pa.int64())), b["values"].take(pa.array(r, pa.int64())), pa.array([flags[i] for i in r], pa.binary()),
                                                  pa.array(to[j:j + 4096], pa.int64())], names=["vec_id", "values", "cells", "block"])

    asked = entries.where(is_query).select("vec_id", "values")
    chunks = max(1, -(-asked.count() // chunk))
    routed = cut(asked.mapInArrow(route, "vec_id long, values binary, cells binary, block long").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks))))
    placed = entries.select("vec_id", "values", "cell", F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 30)).alias("spread")).mapInArrow(
        place, "vec_id long, values binary, cell long, block long")
    needed = routed.select("block", "chunk").distinct()
    both = placed.join(needed, "block").select("block", "chunk", F.lit(False).alias("query"), "vec_id", "values", "cell", F.lit(None).cast("binary").alias("cells")) \
        .union(routed.select("block", "chunk", F.lit(True), "vec_id", "values", F.lit(None).cast("long"), "cells"))
    found = both.groupBy("block", "chunk").applyInPandas(lambda p: best_of(p, dim, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
