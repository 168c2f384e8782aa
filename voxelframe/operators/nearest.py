"""Exact k-nearest join by blocks.

In many dimensions nearly every pair has to be compared: bounds from pivots rule out almost none. So the
comparison is made cheap and even instead: a block of queries meets a block of training rows in one matrix
product, and only the k best of a query in a block leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.operators import grid

QUERIES, TRAIN = 512, 4096   # rows in a block, at most about


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    c = column.combine_chunks()
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)


def best(q: np.ndarray, t: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, training row, distance) of the k nearest, ties by id.

    The product gives squared distances up to rounding; whatever may be among the k nearest within that error is
    measured again from the differences.
    """
    near = (q * q).sum(1)[:, None] + (t * t).sum(1)[None, :] - 2.0 * (q @ t.T)
    scale = (q * q).sum(1) + (t * t).sum(1).max()
    kth = np.partition(near, min(k, len(t)) - 1, axis=1)[:, min(k, len(t)) - 1]
    i, j = np.nonzero(near <= (kth + 1e-9 * scale)[:, None])
    d = np.sqrt(((q[i] - t[j]) ** 2).sum(1))
    order = np.lexsort((ids[j], d, i))
    i, j, d = i[order], j[order], d[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], d[place < k]


def knn(queries: DataFrame, train: DataFrame, k: int, x: str = "x", qid: str = "qid", tid: str = "tid") -> DataFrame:
    """(qid, tid, distance, .., rank): the k nearest training rows, ties by tid; train's columns ride along."""
    rest = [c for c in train.columns if c not in (tid, x)]
    n_q, n_t = queries.count(), train.count()
    qs = max(1, -(-n_q // QUERIES))
    ts = max(1, -(-n_t // TRAIN), min(n_t, -(-grid.parallelism(queries) // qs)))  # enough pairs of blocks for all tasks
    q = queries.select(qid, F.col(x).alias("_x"), F.pmod(F.xxhash64(qid), F.lit(qs)).alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(ts - 1))).alias("_t"))
    t = train.select(tid, x, *rest, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qs - 1).cast("long"))).alias("_q"),
                     F.pmod(F.xxhash64(tid), F.lit(ts)).cast("int").alias("_t"))
    types = dict([*queries.dtypes, *train.dtypes])
    schema = ", ".join(f"`{c}` {kind}" for c, kind in [(qid, types[qid]), (tid, types[tid]), ("distance", "double"), *[(c, types[c]) for c in rest]])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            i = j = np.empty(0, np.int64)
            d = np.empty(0)
        else:
            i, j, d = best(matrix(a["_x"]), matrix(b[x]), b[tid].to_numpy(), k)
        return pa.table({qid: a[qid].take(pa.array(i)), tid: b[tid].take(pa.array(j)), "distance": d, **{c: b[c].take(pa.array(j)) for c in rest}})

    found = q.groupBy("_q", "_t").cogroup(t.groupBy("_q", "_t")).applyInArrow(meet, schema)
    w = Window.partitionBy(qid).orderBy("distance", tid)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vote(neighbours: DataFrame, label: str = "label", weights: str = "uniform", qid: str = "qid") -> DataFrame:
    """(qid, predict): the class with most votes, the smallest on ties."""
    w = F.lit(1.0) if weights == "uniform" else F.try_divide(F.lit(1.0), F.col("distance"))
    v = neighbours.groupBy(qid, label).agg(F.sum(F.coalesce(w, F.lit(1e300))).alias("v"))
    return v.groupBy(qid).agg(F.max_by(label, F.struct("v", -F.col(label))).alias("predict"))
