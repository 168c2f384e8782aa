"""Embedding whitening by spectral divide and conquer.

Spark counts: the distinct integer vectors, their sums, the centred products. What comes to the driver is of the size of one
vector or of one covariance (dimension squared), whatever the number of rows. The covariance is split there by polar
decompositions (dynamically weighted Halley iterations on QR factors): the polar factor of V - s is the sign of V - s, half
of it plus one is the projector onto the components above s, and V restricted to the two subspaces is split again until each
holds one component. The whitening matrix goes to the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import slices, staged

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
EPS = np.finfo(float).eps
EXACT = float(1 << 46)  # entries of this size and more have no exact x
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# ---- spectral divide and conquer on one symmetric matrix ------------------------------------------

def polar_sign(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix, by QR-based dynamically weighted Halley iterations."""
    d = len(a)
    x = a / np.linalg.norm(a)
    r = np.linalg.qr(x, mode="r")
    try:
        low = 1 / (np.linalg.norm(np.linalg.inv(r), 1) * np.sqrt(d))
    except np.linalg.LinAlgError:
        low = EPS
    low, one = min(1.0, max(low, EPS)), np.eye(d)
    for _ in range(30):
        last = x
        w = np.cbrt(4 * (1 - low * low) / low ** 4)
        s = np.sqrt(1 + w)
        p = s + 0.5 * np.sqrt(max(0.0, 8 - 4 * w + 8 * (2 - low * low) / (low * low * s)))
        q = (p - 1) ** 2 / 4
        c = p + q - 1
        factor, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, one]))
        x = (q / c) * x + (p - q / c) / np.sqrt(c) * (factor[:d] @ factor[d:].T)
        x = (x + x.T) / 2
        low = min(1.0, low * (p + q * low * low) / (1 + c * low * low))
        if np.linalg.norm(x - last) < 1e-8 and 1 - low < 1e-8:  # the next step would change nothing: convergence is cubic
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the two invariant subspaces on either side of a shift; None where `a` is a multiple of one."""
    d = len(a)
    level = np.trace(a) / d
    size = np.linalg.norm(a - level * np.eye(d))
    if size <= 4 * EPS * np.linalg.norm(a):
        return None
    # the median halves well, the mean always lies strictly inside the spectrum; a shift may hit a component: move it a little
    for shift in (np.median(np.diag(a)), level, level + 1e-3 * size / d, level - 1e-3 * size / d):
        sign = polar_sign(a - shift * np.eye(d)) if np.linalg.norm(a - shift * np.eye(d)) > 0 else np.zeros((d, d))
        projector = (sign + np.eye(d)) / 2
        rank = int(round(np.trace(projector)))
        if 0 < rank < d and np.linalg.norm(projector @ projector - projector) < 1e-6:
            start = np.random.default_rng(d).standard_normal((d, rank))
            above = np.linalg.qr(projector @ start)[0]
            q = np.linalg.qr(projector @ above, mode="complete")[0]
            return q[:, :rank], q[:, rank:]
    return None


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix."""
    out: list[np.ndarray] = []
    left = [np.eye(len(a))]
    while left:
        basis = left.pop()
        inner = basis.T @ a @ basis
        halves = split((inner + inner.T) / 2) if basis.shape[1] > 1 else None
        if halves is None:
            out.append(basis)
        else:
            left += [basis @ h for h in halves]
    vectors = np.linalg.qr(np.hstack(out))[0] if out else np.empty((0, 0))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# ---- counting with Spark ------------------------------------------------------------------------

def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole: not null, all entries there and finite, and of the commonest length.

    A vector of another length lacks entries of the space the others live in, which counts as null ones (of lengths equally
    common the greatest holds). Entries of 2^46 and more raise.
    """
    v = F.transform(F.col(f"`{vector_col}`"), lambda e: e.cast("double"))
    some = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where("v IS NOT NULL")
    some = some.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))))
    top = some.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    x = F.transform("v", lambda e: F.when(F.abs(e) < EXACT, F.floor(e * SCALE) + SHIFT).otherwise(
        F.raise_error(F.lit("embedding entry too large for exact whitening")).cast("long")))
    return some.where(F.size("v") == (top[0]["d"] if top else 0)).select("vec_id", x.alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(x: DataFrame, width: int, fn: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum over all rows of fn(rows of x) (an array of `width` columns), in each task, then over tasks by Spark.

    Rows of the result come to the driver: one vector's or one covariance's size.
    """
    schema = f"i int, row array<{kind}>"
    of = {"long": pa.int64(), "double": pa.float64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices(batches):
            if batch.num_rows:
                part = fn(_matrix(batch))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(of))], names=["i", "row"])

    one = x.select("x").mapInArrow(run, schema).select("i", F.posexplode("row").alias("j", "v"))
    rows = one.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((1 + max((r["i"] for r in rows), default=-1), width), np.int64 if kind == "long" else float)
    for r in rows:
        out[r["i"], r["j"]] = r["v"]
    return out


def covariance(x: DataFrame, n: int, width: int, place: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Covariance (divisor n) of place(rows), which centres before anything is multiplied."""
    def products(rows: np.ndarray) -> np.ndarray:
        y = place(rows)
        return y.T @ y
    return summed(x, width, products, "double") / n


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each whole vector and component.

    The fit list is every distinct x once, so copies weigh nothing. Components without variance (below the rounding of the
    largest one) are left out, as nothing can be scaled by them: a table of one distinct vector gives no rows, as does an
    empty one. Equal rows and null ids keep a row each. Vectors: see `integers`. Other columns are ignored. Deviations beyond
    64 bits raise.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vector_col)
    fit = staged(rows.select("x").distinct(), "fit")  # copies are merged before the exchange
    n = fit.count()
    width = len(fit.first()["x"]) if n else 0
    if not width:
        return spark.createDataFrame([], RESULT)
    sums = summed(fit, width, lambda x: x.sum(0, keepdims=True), "long")[0]
    centre = lambda x: (n * x - sums) / n  # noqa: E731  # the difference is exact, in integers
    v = covariance(fit, n, width, centre)
    values, axes = components(v)
    kept = min(most, int((values > 64 * width * EPS * max(values[0], 0)).sum()))
    if not kept:
        return spark.createDataFrame([], RESULT)
    explained = values[:kept] / np.trace(v)
    basis = axes[:, :kept] / np.sqrt(values[:kept])
    error = float(np.abs(covariance(fit, n, kept, lambda x: centre(x) @ basis) - np.eye(kept)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            if not batch.num_rows:
                continue
            y = n * _matrix(batch) - sums
            if (np.square(y.astype(float)).sum(1) > 9e18).any():
                raise OverflowError("deviation beyond 64 bits")
            m = len(y)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), kept))), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)),
                pa.array(np.full(m * kept, n)), pa.array(np.repeat(np.square(y).sum(1), kept)), pa.array(((y / n) @ basis).ravel()),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error))], names=[c.split()[0] for c in RESULT.split(", ")])

    return rows.mapInArrow(run, RESULT)
