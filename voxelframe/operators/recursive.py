"""Recursive filters along an axis: damped cosines whose cost does not grow with their width.

An even kernel h(k) = sum over poles of (a cos(turn |k|) + b sin(turn |k|)) exp(-decay |k|) needs two running sums a pole and
direction. Lines are cut into blocks; each block also gets the cells within ``halo`` of it, beyond which the kernel is below double
precision, so neither a line nor a volume is ever one task and an axis costs one exchange. The sums only grow towards the cell
they are read at, so they lose no precision, and a block is short enough for the growth to stay within a double.
"""

from __future__ import annotations

import cmath
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FADED = 37.0    # exp(-37) is below double precision
GROWTH = 600.0  # exp(600) is within a double
SPLINE_POLE = math.sqrt(3.0) - 2.0
SPLINE = ([(-math.log(-SPLINE_POLE), math.pi)], [[(math.sqrt(3.0), 0.0)]])
# decay and turn of the pole pairs of a Gaussian of unit width: a search for the least error of both kernels (1e-4 of their peaks)
GAUSS_POLES = ((2.0085, 0.5049), (1.9316, 1.5623), (1.8138, 2.8352))


def reach(poles) -> tuple[int, int]:
    """(halo, block): cells beyond which nothing is felt, and cells of a block."""
    halo = math.ceil(FADED / min(d for d, _ in poles))
    return halo, max(1, int(GROWTH / max(d for d, _ in poles)) - 2 * halo)


def response(poles, coefficients, k: np.ndarray) -> np.ndarray:
    """The kernel at the given distances."""
    k = np.abs(np.asarray(k, dtype=float))
    return sum((a * np.cos(w * k) + b * np.sin(w * k)) * np.exp(-d * k) for (d, w), (a, b) in zip(poles, coefficients))


def gaussian(width: float):
    """(poles, [smoothing, second derivative]) for a Gaussian of ``width`` cells.

    Least squares against the sampled kernels, under the constraints that moments 0 and 2 are right: polynomials up to the third
    degree come out exact.
    """
    poles = [(d / width, w / width) for d, w in GAUSS_POLES]
    k = np.arange(reach(poles)[0] + 1, dtype=float)
    basis = np.stack([f(w * k) * np.exp(-d * k) for d, w in poles for f in (np.cos, np.sin)], axis=1)
    twice = np.where(k == 0, 1.0, 2.0)
    g = np.exp(-k * k / (2 * width * width))
    g /= (g * twice).sum()
    h = (k * k / width ** 4 - 1 / width ** 2) * g
    moments = np.stack([twice @ basis, (twice * k * k) @ basis])
    free = np.linalg.svd(moments)[2][2:].T  # directions that leave the moments as they are
    weigh, out = np.sqrt(twice), []
    for target, wanted in ((g, (1.0, width * width)), (h, (0.0, 2.0))):
        x = np.linalg.lstsq(moments, np.array(wanted), rcond=None)[0]
        x = x + free @ np.linalg.lstsq((basis @ free) * weigh[:, None], (target - basis @ x) * weigh, rcond=None)[0]
        out.append([(float(p), float(q)) for p, q in x.reshape(-1, 2)])
    return poles, out


def _images(k: Column, n: Column, zero: Column, pole) -> tuple[Column, Column]:
    """What the mirror images of the cell k cells from the end of a line of n add to the sums of its other side, where the end
    has place ``zero`` in the sums: a geometric series, as the mirrored line repeats."""
    d, turn = pole
    period = F.greatest((n - 1) * 2, F.lit(1))
    grown = lambda y: (F.exp(y * d) * F.cos(y * turn), F.exp(y * d) * F.sin(y * turn))
    once, again = grown(zero - k), grown(zero - (period - k))
    cos, sin = (F.when(k > 0, x).otherwise(0.0) + F.when((k < n - 1) | (n == 1), y).otherwise(0.0) for x, y in zip(once, again))
    fade = F.exp(period * -d)
    real, imag = 1.0 - fade * F.cos(period * turn), fade * F.sin(period * turn)
    size = real * real + imag * imag
    return (cos * real + sin * imag) / size, (sin * real - cos * imag) / size


def along(vox: DataFrame, axis: str, poles, outputs, border: str = "edge", line=("case_id",)) -> DataFrame:
    """Filter v along one axis; several outputs share the running sums and fill v0, v1, .. (one fills v).

    ``line`` are the columns that, beside nothing else, tell the lines of this axis apart: the case key and the two other axes.
    The table carries the first and last coordinate of the axis as <axis>_lo and <axis>_hi; cells it does not hold count as 0
    and stay out of the result. A null v counts as 0 for the others.
    """
    halo, block = reach(poles)
    n = F.col(f"{axis}_hi") - F.col(f"{axis}_lo") + 1
    s = F.col(axis) - F.col(f"{axis}_lo")
    if border not in ("edge", "mirror"):
        raise ValueError(f"border {border}")
    low, high = (F.floor((s + o) / block).cast("int") for o in (-halo, halo))
    last = F.floor((n - 1) / block).cast("int")
    e = vox.withColumn("_b", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, last))))
    e = e.withColumn("_i", s - F.col("_b") * block + halo)
    place, v = F.col("_i").cast("double"), F.coalesce("v", F.lit(0.0))
    sides = []
    for side, at, order, k_end in (("f", place, F.asc("_i"), s), ("r", F.lit(float(block + 2 * halo - 1)) - place, F.desc("_i"), n - 1 - s)):
        end, zero = k_end == 0, at - k_end  # the end of the line, and its place
        ordered = Window.partitionBy(*line, "_b").orderBy(order)
        w, every = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow), ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        for k, (d, turn) in enumerate(poles):
            grown, cos, sin = v * F.exp(at * d), F.cos(at * turn), F.sin(at * turn)
            if border == "edge":  # the end cell repeats for ever: a geometric series
                ever = 1 / (1 - cmath.exp(complex(-d, -turn)))
                cos, sin = (F.when(end, x).otherwise(y) for x, y in ((cos * ever.real - sin * ever.imag, cos), (sin * ever.real + cos * ever.imag, sin)))
            sums = [F.sum(grown * cos).over(w), F.sum(grown * sin).over(w)]
            if border == "mirror":  # of a block that reaches the end; it holds all cells whose images are felt
                sums = [x + F.sum(F.when(zero >= 0, v * y).otherwise(0.0)).over(every) for x, y in zip(sums, _images(k_end, n, zero, (d, turn)))]
            sides.append({f"_c{side}{k}": sums[0], f"_s{side}{k}": sums[1]})
        sides.append((side, at))
    for c in sides:
        e = e.withColumns(c) if isinstance(c, dict) else e
    own = e.where(F.floor(s / block) == F.col("_b"))
    vals = []
    for coefficients in outputs:
        total = -v * sum(a for a, _ in coefficients)  # the cell itself is in both directions
        for side, at in (c for c in sides if isinstance(c, tuple)):
            for k, ((d, turn), (a, b)) in enumerate(zip(poles, coefficients)):
                cos, sin = F.cos(at * turn), F.sin(at * turn)
                total = total + F.exp(-at * d) * ((cos * a + sin * b) * F.col(f"_c{side}{k}") + (sin * a - cos * b) * F.col(f"_s{side}{k}"))
        vals.append(total)
    names = ["v"] if len(outputs) == 1 else [f"v{k}" for k in range(len(outputs))]
    return own.select(*[c for c in vox.columns if c != "v"], *[x.alias(c) for x, c in zip(vals, names)])


def spline_weight(x: Column) -> Column:
    """Cubic B-spline at distance x."""
    a = F.abs(x)
    return F.when(a < 1, 2.0 / 3.0 - a * a + a * a * a / 2.0).when(a < 2, (2.0 - a) * (2.0 - a) * (2.0 - a) / 6.0).otherwise(0.0)


def spline_axis(vox: DataFrame, axis: str, targets: DataFrame, keys=("case_id",), others=(), by_case: bool = False) -> DataFrame:
    """Cubic spline of v along one axis at the target places: (keys, others, axis, v); coefficients and taps mirror at both ends.

    ``targets`` has keys, n (cells of the axis), t (new coordinate) and p (place in old cells, from 0): one small row per case and
    new coordinate, joined by case and cell, so a large case is spread over its cells. Tables placed ``by_case`` stay where they are.
    """
    keys, others = list(keys), list(others)
    c = along(vox, axis, *SPLINE, border="mirror", line=[*keys, *others])
    period = F.greatest((F.col("n") - 1) * 2, F.lit(1))
    tap = targets.withColumn("j", F.explode(F.array(*[F.floor("p").cast("int") + o for o in (-1, 0, 1, 2)])))
    tap = tap.withColumn("w", spline_weight(F.col("p") - F.col("j"))).where("w > 0")
    turned = F.pmod("j", period)
    cell = F.when(F.col("n") == 1, 0).when(turned >= F.col("n"), period - turned).otherwise(turned)
    tap = tap.groupBy(*keys, "t", cell.cast("int").alias("_s")).agg(F.sum("w").alias("w"))
    j = c.withColumn("_s", F.col(axis) - F.col(f"{axis}_lo")).drop(axis).join(tap.hint("shuffle_hash") if by_case else tap, [*keys, "_s"])
    return j.groupBy(*keys, *others, F.col("t").alias(axis)).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
