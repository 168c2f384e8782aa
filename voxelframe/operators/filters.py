"""Image operators on the voxel table: cropping, regridding, intensity and convolution filters.

Per-case scalars (range, mean) are aggregates joined back; convolutions run one axis at a time as a
weighted sum over shifted copies that are made after placing the cells by line block.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.operators import grid, recursive
from voxelframe.session import stage

AXES = ("z", "y", "x")


def axis_permute(vox: DataFrame, keys=("case_id",)) -> DataFrame:
    """Where the last two axes differ in length, the last axis becomes the first."""
    size = vox.groupBy(*keys).agg((F.max("y") - F.min("y")).alias("ny"), (F.max("x") - F.min("x")).alias("nx"))
    move = F.col("ny") != F.col("nx")
    j = vox.join(size, list(keys))
    new = {a: F.when(move, F.col(b)).otherwise(F.col(a)) for a, b in (("z", "x"), ("y", "z"), ("x", "y"))}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in vox.columns])


def crop(vox: DataFrame, pad: int = 0, shift: bool = True, keys=("case_id",), label: int = 1) -> DataFrame:
    """Cells inside the region's box, padded and clamped to the image; origin moved to the box."""
    m = F.when(F.col("m") == label, 1)
    aggs = []
    for a in AXES:
        aggs += [F.min(F.when(m == 1, F.col(a))).alias(f"{a}0"), F.max(F.when(m == 1, F.col(a))).alias(f"{a}1"),
                 F.min(a).alias(f"{a}a"), F.max(a).alias(f"{a}b")]
    j = vox.join(vox.groupBy(*keys).agg(*aggs), list(keys))
    cond, out = F.col("z0").isNotNull(), {}
    for a in AXES:
        lo = F.greatest(F.col(f"{a}0") - pad, F.col(f"{a}a"))
        hi = F.least(F.col(f"{a}1") + pad, F.col(f"{a}b"))
        cond = cond & F.col(a).between(lo, hi)
        out[a] = (F.col(a) - lo).cast("int") if shift else F.col(a)
    return j.where(cond).select(*[out[c].alias(c) if c in out else F.col(c) for c in vox.columns])


def _whole(vox: DataFrame, keys, **aggs: Column) -> DataFrame:
    return vox.join(vox.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), list(keys))


def normalise(vox: DataFrame, scale: float = 1.0, clip: float | None = None, keys=("case_id",)) -> DataFrame:
    """(v - mean) / sd over the whole image, optionally clipped at clip sds, times scale."""
    j = _whole(vox, keys, mu=F.avg("v"), sd=F.stddev_samp("v"))
    v = (F.col("v") - F.col("mu")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    if clip is not None:
        v = F.greatest(F.least(v, F.lit(float(clip))), F.lit(-float(clip)))
    return j.withColumn("v", v * scale).select(*vox.columns)


def resegment(vox: DataFrame, low: float, high: float | None = None, mode: str = "absolute",
              keys=("case_id",), label: int = 1) -> DataFrame:
    """Region cells inside the thresholds; a case left with one cell or none is dropped."""
    cells = grid.roi(vox, label)
    if mode == "absolute":
        a, b = F.lit(low), F.lit(high) if high is not None else None
        j = cells
    elif mode == "relative":
        j = _whole(cells, keys, top=F.max("v"))
        a, b = F.col("top") * low, F.col("top") * high if high is not None else None
    else:
        j = _whole(cells, keys, mu=F.avg("v"), sd=F.stddev_pop("v"))
        a, b = F.col("mu") + F.col("sd") * low, F.col("mu") + F.col("sd") * high if high is not None else None
    cond = F.col("v") >= a
    if b is not None:
        cond = cond & (F.col("v") <= b)
    kept = j.where(cond).select(*vox.columns)
    enough = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("left")).where("left > 1").select(*keys)
    return kept.join(enough, list(keys), "left_semi")


# ---- intensity filters ------------------------------------------------------------------------------

def square(vox, keys=("case_id",)):
    j = _whole(vox, keys, top=F.max(F.abs("v")))
    x = F.col("v") / F.sqrt("top")
    return j.withColumn("v", F.coalesce(x * x, F.lit(0.0))).select(*vox.columns)


def square_root(vox, keys=("case_id",)):
    j = _whole(vox, keys, top=F.max(F.abs("v")))
    return j.withColumn("v", F.signum("v") * F.sqrt(F.abs("v") * F.col("top"))).select(*vox.columns)


def logarithm(vox, keys=("case_id",)):
    j = _whole(vox, keys, top=F.max(F.abs("v")))
    scale = F.try_divide(F.col("top"), F.log(F.col("top") + 1.0))
    return j.withColumn("v", F.signum("v") * F.log(F.abs("v") + 1.0) * scale).select(*vox.columns)


def exponential(vox, keys=("case_id",)):
    j = _whole(vox, keys, top=F.max(F.abs("v")))
    return j.withColumn("v", F.exp(F.col("v") * F.log("top") / F.col("top"))).select(*vox.columns)


# ---- neighbourhood filters ------------------------------------------------------------------------------

def _image_box(vox, keys):
    return vox.groupBy(*keys).agg(*[f(a).alias(f"{a}{s}") for a in AXES for f, s in ((F.min, "_lo"), (F.max, "_hi"))])


def _boxed(vox: DataFrame, keys) -> DataFrame:
    """Cells that carry the first and last coordinate of each axis of their volume."""
    return vox.join(_image_box(vox, list(keys)), list(keys))


def convolve(vox: DataFrame, axis: str, taps, border: str = "edge", keys=("case_id",)) -> DataFrame:
    """Sum of taps (offset, weight, [name]) times the cell at that offset along one axis.

    Cells are placed by line (never longer than the axis) and each sends its weighted value to the
    cells it reaches after that exchange, so one axis costs one shuffle of the plain cells. Targets
    past the border wrap or repeat the edge. Several outputs (bands) can be produced at once: a tap
    (offset, (w0, w1, ..)) fills columns v0, v1, .. A volume that carries its box (see _boxed) is not
    measured again.
    """
    keys = list(keys)
    line = [*keys, *[a for a in AXES if a != axis]]
    placed = vox.repartition(grid.parallelism(vox), *line)
    j = placed if f"{axis}_lo" in vox.columns else placed.join(_image_box(vox, keys).select(*keys, f"{axis}_lo", f"{axis}_hi"), keys)
    lo, hi = F.col(f"{axis}_lo"), F.col(f"{axis}_hi")
    n = hi - lo + 1
    bands = len(taps[0][1])
    tap = F.array(*[F.struct(F.lit(o).alias("o"), *[F.lit(float(w)).alias(f"w{k}") for k, w in enumerate(ws)])
                    for o, ws in taps])
    rest = [c for c in vox.columns if c not in ("v", axis)]
    if border == "wrap":  # an odd axis is lengthened by one wrapped cell, as for a dyadic transform
        even = n + n % 2
        src = F.col(axis) - lo
        copies = F.when((n % 2 == 1) & (src == 0), F.array(src, n)).otherwise(F.array(src))
        e = j.withColumn("s", F.explode(copies)).withColumn("t", F.explode(tap))
        e = e.withColumn("to", F.pmod(F.col("s") - F.col("t.o"), even) + lo).where(F.col("to") <= hi)
    else:
        reach = max(abs(o) for o, _ in taps)
        # the edge cell also stands for the cells beyond it
        src = F.col(axis)
        copies = F.when(lo == hi, F.sequence(src - reach, src + reach)).when(
            src == lo, F.sequence(src - reach, src)).when(src == hi, F.sequence(src, src + reach)).otherwise(F.array(src))
        e = j.withColumn("s", F.explode(copies)).withColumn("t", F.explode(tap))
        e = e.withColumn("to", F.col("s") - F.col("t.o")).where(F.col("to").between(lo, hi))
    val = [F.sum(F.col("v") * F.col(f"t.w{k}")).alias(f"v{k}" if bands > 1 else "v") for k in range(bands)]
    first = [F.max(F.when(F.col("to") == F.col(axis), F.col("m"))).alias("m")] if "m" in rest else []
    by = [c for c in rest if c != "m"]
    out = e.groupBy(*by, F.col("to").cast("int").alias(axis)).agg(*val, *first)
    return out


def gradient(vox: DataFrame, spacing=(1.0, 1.0, 1.0), keys=("case_id",)) -> DataFrame:
    """Magnitude of the central differences; the edge repeats past the border."""
    keys = list(keys)
    offs = [(k, 1, *o) for k, o in enumerate(((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))]
    p = grid.neighbour_pairs(vox, offs, carry=("v",), keys=keys, left=True)
    p = p.withColumn("n", F.coalesce("v2", "v"))
    side = {}
    for k, (a, _) in enumerate(product(AXES, (1, -1))):
        side.setdefault(a, []).append(F.max(F.when(F.col("angle") == k, F.col("n"))))
    rest = [c for c in vox.columns if c not in (*AXES, "v", *keys)]
    g = p.groupBy(*keys, "bz", "by", "bx", *AXES, *rest).agg(
        *[((pos - neg) / (2.0 * float(s))).alias(f"d{a}") for (a, (pos, neg)), s in zip(side.items(), spacing)])
    v = F.sqrt(F.col("dz") * F.col("dz") + F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"))
    return g.withColumn("v", v).select(*vox.columns)


def gaussian_taps(sigma: float, spacing: float, order: int = 0):
    """Sampled Gaussian (order 0) or its second derivative (order 2), truncated at four sigma."""
    s = sigma / spacing
    r = max(1, math.ceil(4 * s))
    g = {k: math.exp(-k * k / (2 * s * s)) for k in range(-r, r + 1)}
    total = sum(g.values())
    if order == 0:
        return [(k, (g[k] / total,)) for k in g]
    h = {k: (k * k / s ** 4 - 1 / s ** 2) * g[k] / total for k in g}
    mean = sum(h.values()) / len(h)
    return [(k, (h[k] - mean,)) for k in h]


def log_sigma(vox: DataFrame, sigma: float, spacing=(1.0, 1.0, 1.0), keys=("case_id",), how: str = "taps") -> DataFrame:
    """Scale-normalised Laplacian of Gaussian: one smoothing pass per axis yields both orders.

    ``how`` is "taps" (cut at four sigma; an axis costs as many rows as taps) or "recursive" (running sums, one row a cell
    whatever the sigma; within about 1e-4 of the kernel's peak; cells that the table does not hold stay out).
    Cases whose axes are shorter than 4 cells or than ceil(sigma / spacing) + 1 are left out.
    """
    if how not in ("taps", "recursive"):
        raise ValueError(f"how {how}")
    keys = list(keys)
    ok = F.lit(True)
    for a, s in zip(AXES, spacing):
        ok = ok & (F.col(f"{a}_hi") - F.col(f"{a}_lo") + 1 >= max(4, math.ceil(sigma / s) + 1))
    df = _boxed(vox, keys).where(ok)
    df = df.withColumn("k", F.lit(""))  # which axes were differentiated so far
    for a, s in zip(AXES, spacing):
        if how == "taps":
            g, h = gaussian_taps(sigma, s), dict(gaussian_taps(sigma, s, 2))
            both = convolve(df, a, [(o, (w[0], h[o][0] / (s * s))) for o, w in g], keys=keys)
        else:
            both = recursive.along(df, a, *recursive.gaussian(sigma / s), line=[*keys, "k", *[o for o in AXES if o != a]])
            both = both.withColumn("v1", F.col("v1") / (s * s))
        pair = F.array(F.struct(F.lit("g").alias("t"), F.col("v0").alias("v")),
                       F.struct(F.lit("d").alias("t"), F.col("v1").alias("v")))
        both = both.withColumn("p", F.explode(pair)).withColumn("v", F.col("p.v"))
        both = both.withColumn("k", F.concat("k", "p.t"))
        df = both.where(F.length(F.regexp_replace("k", "g", "")) <= 1).drop("p", "v0", "v1")
    by = [c for c in vox.columns if c != "v"]
    return df.where(F.col("k").contains("d")).groupBy(*by).agg(
        (F.sum("v") * float(sigma * sigma)).alias("v")).select(*vox.columns)


# fixed values: the six low-pass taps of the coif1 wavelet
COIF1 = (-0.01565572813546454, -0.0727326195128539, 0.38486484686420286,
         0.8525720202122554, 0.3378976624578092, -0.0727326195128539)


def wavelet_taps(low=COIF1):
    """(offset, (low, high)) of one stationary level, centred on the filter."""
    n = len(low)
    high = [(-1) ** (k + 1) * low[n - 1 - k] for k in range(n)]
    return [(n // 2 - k, (low[k], high[k])) for k in range(n)]


def wavelet(vox: DataFrame, low=COIF1, axes=("x", "y", "z"), keys=("case_id",), level: int = 1,
            start_level: int = 0) -> DataFrame:
    """Stationary transform: every combination of low and high pass, one axis at a time.

    The result has an ``image_type`` column (one letter per axis, first axis first) and, beyond level 1, the
    approximation is transformed again. An odd axis is lengthened once, before the first level, by its wrapped first
    cell, which goes on through the levels and is left out of the results.
    """
    cur, out = _boxed(vox, keys), None
    for a in axes:
        cur = cur.withColumn(f"{a}_odd", (F.col(f"{a}_hi") - F.col(f"{a}_lo")) % 2 == 0)
        odd = F.col(f"{a}_odd")
        cur = cur.withColumn(a, F.explode(F.when(odd & (F.col(a) == F.col(f"{a}_lo")), F.array(F.col(a), F.col(f"{a}_hi") + 1))
                                          .otherwise(F.array(a))))
        cur = cur.withColumn(f"{a}_hi", F.col(f"{a}_hi") + odd.cast("int"))
    inside = F.lit(True)
    for a in axes:
        inside = inside & ((F.col(a) < F.col(f"{a}_hi")) | ~F.col(f"{a}_odd"))
    for lv in range(start_level + level):
        df = cur.withColumn("band", F.lit(""))
        for a in axes:
            both = convolve(df, a, wavelet_taps(low), border="wrap", keys=keys)
            pair = F.array(F.struct(F.lit("L").alias("t"), F.col("v0").alias("v")),
                           F.struct(F.lit("H").alias("t"), F.col("v1").alias("v")))
            df = both.withColumn("p", F.explode(pair)).withColumn("v", F.col("p.v"))
            df = df.withColumn("band", F.concat("band", "p.t")).drop("p", "v0", "v1")
        approx = "L" * len(axes)
        cur = df.where(F.col("band") == approx).drop("band")
        if lv < start_level:
            continue
        last = lv == start_level + level - 1
        tag = "wavelet" if lv == start_level else f"wavelet{lv - start_level + 1}"
        part = df if last else df.where(F.col("band") != approx)
        part = part.where(inside).select(*vox.columns, F.concat(F.lit(f"{tag}-"), "band").alias("image_type"))
        out = part if out is None else out.unionByName(part)
    return out


def lbp2d(vox: DataFrame, keys=("case_id",)) -> DataFrame:
    """Uniform local binary pattern per slice, 8 samples on the unit circle, zero past the border.

    Diagonal samples are bilinear: the four cells around each sample point, placed by block.
    """
    keys = list(keys)
    c = round(math.cos(math.pi / 4), 5)
    samples = []
    for k in range(8):
        dy, dx = round(-math.sin(2 * math.pi * k / 8), 5), round(math.cos(2 * math.pi * k / 8), 5)
        y0, x0 = math.floor(dy), math.floor(dx)
        fy, fx = dy - y0, dx - x0
        for oy, ox, w in ((0, 0, (1 - fy) * (1 - fx)), (0, 1, (1 - fy) * fx), (1, 0, fy * (1 - fx)), (1, 1, fy * fx)):
            if w > 0:
                samples.append((k, y0 + oy, x0 + ox, w))
    offs = [(i, 1, 0, y, x) for i, (_, y, x, _) in enumerate(samples)]
    p = grid.neighbour_pairs(vox, offs, carry=("v",), keys=keys, left=True)
    wt = F.element_at(F.array(*[F.lit(float(s[3])) for s in samples]), F.col("angle") + 1)
    sid = F.element_at(F.array(*[F.lit(s[0]) for s in samples]), F.col("angle") + 1)
    p = p.withColumn("s", sid).withColumn("u", F.coalesce("v2", F.lit(0.0)) * wt)
    rest = [c for c in vox.columns if c not in (*AXES, *keys, "v")]
    cell = [*keys, "bz", "by", "bx", *AXES, *rest, "v"]
    q = p.groupBy(*cell).agg(*[F.sum(F.when(F.col("s") == k, F.col("u"))).alias(f"s{k}") for k in range(8)])
    bits = [F.when(F.col(f"s{k}") - F.col("v") >= 0, 1).otherwise(0) for k in range(8)]
    q = q.select(*[c for c in cell if c not in ("bz", "by", "bx")], *[b.alias(f"b{k}") for k, b in enumerate(bits)])
    turns = sum((F.abs(F.col(f"b{k}") - F.col(f"b{(k + 1) % 8}")) for k in range(1, 8)),
                F.abs(F.col("b0") - F.col("b1")))
    ones = sum((F.col(f"b{k}") for k in range(1, 8)), F.col("b0"))
    return q.withColumn("v", F.when(turns <= 2, ones).otherwise(9).cast("double")).select(*vox.columns)


# ---- regridding -------------------------------------------------------------------------------------------

def _target_axis(df: DataFrame, a: str, s: float) -> DataFrame:
    """A row per new coordinate t<axis> of one axis, with its place p<axis> in old cells."""
    step = F.when((F.lit(float(s)) == 0) | (F.col(f"n{a}") == 1), F.col(f"d{a}")).otherwise(F.lit(float(s)))
    df = df.withColumn(f"step{a}", step)
    size = F.ceil(F.round(F.col(f"n{a}") * F.col(f"d{a}") / F.col(f"step{a}"), 6)).cast("int")
    df = df.withColumn(f"t{a}", F.explode(F.sequence(F.lit(0), size - 1)))
    # cell centres of both grids share the outer boundary
    pos = (F.col(f"t{a}") + 0.5) * F.col(f"step{a}") / F.col(f"d{a}") - 0.5
    return df.withColumn(f"p{a}", F.least(F.greatest(pos, F.lit(0.0)), (F.col(f"n{a}") - 1).cast("double")))


def target_grid(geo: DataFrame, new_spacing, keys=("case_id",)) -> DataFrame:
    """Cells of the resampled grid. ``geo`` has n<axis> (size) and d<axis> (spacing) per case.

    A spacing of 0 keeps the old one, a single-slice axis is kept. The origin is the first cell.
    """
    df = geo
    for a, s in zip(AXES, new_spacing):
        df = _target_axis(df, a, s)
    return df.select(*keys, *[f"t{a}" for a in AXES], *[f"p{a}" for a in AXES])


LOCAL_CELLS = 1 << 17  # a case of at most so many cells, old or new, is resampled by a spline in one task
TASK_CELLS = 1 << 18   # cells of a task, unless one case has more


def _spline(vox: DataFrame, geo: DataFrame, new_spacing, keys) -> DataFrame:
    """Cells of a case that fits a task are exchanged once for all three axes; larger cases once or more an axis, by line and cell."""
    size = F.lit(1.0)
    for a, s in zip(AXES, new_spacing):
        old = F.col(f"n{a}").cast("double")
        size = size * (old if s == 0 else F.greatest(old, F.ceil(old * F.col(f"d{a}") / F.lit(float(s)))))
    geo = stage(geo.withColumn("_size", size), "geometry")
    total, largest = geo.agg(F.sum(F.least("_size", F.lit(float(LOCAL_CELLS)))), F.max("_size")).first()
    tasks = max(vox.sparkSession.sparkContext.defaultParallelism, math.ceil((total or 0) / TASK_CELLS))
    small = geo.where(F.col("_size") <= LOCAL_CELLS).repartition(tasks, *keys)
    if (largest or 0) <= LOCAL_CELLS:
        return _spline_axes(vox.select(*keys, *AXES, "v").repartition(tasks, *keys), small, new_spacing, keys, True)
    ids = F.broadcast(geo.where(F.col("_size") > LOCAL_CELLS).select(*keys))  # at most one case in LOCAL_CELLS cells
    rest = vox.join(ids, keys, "left_anti").select(*keys, *AXES, "v").repartition(tasks, *keys)
    large = geo.where(F.col("_size") > LOCAL_CELLS)
    return _spline_axes(rest, small, new_spacing, keys, True).unionByName(
        _spline_axes(vox.join(ids, keys, "left_semi"), large, new_spacing, keys, False))


def _spline_axes(vox: DataFrame, geo: DataFrame, new_spacing, keys, by_case: bool) -> DataFrame:
    sizes = geo.select(*keys, *[f"n{a}" for a in AXES])
    cur = vox.join(sizes.hint("shuffle_hash") if by_case else sizes, keys)
    box = {f"{a}_{e}": F.lit(0) if e == "lo" else F.col(f"n{a}") - 1 for a in AXES for e in ("lo", "hi")}
    for a, s in zip(AXES, new_spacing):
        rest = [o for o in AXES if o != a]
        left = [c for o in AXES[AXES.index(a) + 1:] for c in (f"{o}_lo", f"{o}_hi")]  # boxes of the axes still to come
        cur = (cur.withColumns(box) if a == AXES[0] else cur).select(*keys, *AXES, "v", f"{a}_lo", f"{a}_hi", *left)
        to = _target_axis(geo, a, s).select(*keys, F.col(f"n{a}").alias("n"), F.col(f"t{a}").alias("t"), F.col(f"p{a}").alias("p"))
        cur = recursive.spline_axis(cur, a, to, keys, [*rest, *left], by_case)
    return cur.select(*keys, *AXES, "v")


def resample(vox: DataFrame, geo: DataFrame, new_spacing, how: str = "linear", keys=("case_id",)) -> DataFrame:
    """Interpolate v on the new grid: trilinear over 8 cells ("linear"), the nearest cell, or a cubic spline through the cells.

    The spline goes one axis after the other: coefficients by a recursive filter, then four taps a target, mirrored at both ends.
    """
    keys = list(keys)
    if how not in ("linear", "nearest", "spline"):
        raise ValueError(f"how {how}")
    if how == "spline":
        return _spline(vox, geo, new_spacing, keys)
    t = target_grid(geo, new_spacing, keys)
    if how == "nearest":
        src = t.select(*keys, *[f"t{a}" for a in AXES],
                       *[F.floor(F.col(f"p{a}") + 0.5).cast("int").alias(a) for a in AXES])
        out = src.join(vox, [*keys, *AXES], "left")  # a cell that a sparse table does not hold is 0
        return out.select(*keys, *[F.col(f"t{a}").alias(a) for a in AXES], F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("m", F.lit(0)).alias("m"))
    corner = F.array(*[F.struct(*[F.lit(b).alias(a) for a, b in zip(AXES, bits)]) for bits in product((0, 1), repeat=3)])
    e = t.withColumn("c", F.explode(corner))
    w = F.lit(1.0)
    for a in AXES:
        f = F.col(f"p{a}") - F.floor(f"p{a}")
        w = w * F.when(F.col(f"c.{a}") == 1, f).otherwise(1.0 - f)
        e = e.withColumn(a, (F.floor(f"p{a}") + F.col(f"c.{a}")).cast("int"))
    e = e.withColumn("w", w).where("w > 0").drop("c")
    j = e.join(vox.select(*keys, *AXES, "v"), [*keys, *AXES])
    return j.groupBy(*keys, *[f"t{a}" for a in AXES]).agg(F.sum(F.col("w") * F.col("v")).alias("v")).select(
        *keys, *[F.col(f"t{a}").alias(a) for a in AXES], "v")


def mask_regrid(mask: DataFrame, mask_geo: DataFrame, image_geo: DataFrame, keys=("case_id",)) -> DataFrame:
    """The mask on the image's grid: nearest mask cell, 0 outside the mask's extent.

    Geometries carry n<axis>, d<axis>, o<axis> (size, spacing, origin of the first cell centre).
    """
    keys = list(keys)
    g = image_geo
    for a in AXES:
        g = g.withColumn(f"t{a}", F.explode(F.sequence(F.lit(0), F.col(f"n{a}") - 1)))
        g = g.withColumn(f"w{a}", F.col(f"o{a}") + F.col(f"t{a}") * F.col(f"d{a}"))
    g = g.select(*keys, *[f"t{a}" for a in AXES], *[f"w{a}" for a in AXES])
    j = g.join(mask_geo.select(*keys, *[f"{p}{a}" for a in AXES for p in "od"]), keys)
    for a in AXES:
        j = j.withColumn(a, F.floor((F.col(f"w{a}") - F.col(f"o{a}")) / F.col(f"d{a}") + 0.5).cast("int"))
    out = j.join(mask.select(*keys, *AXES, "m"), [*keys, *AXES], "left")
    return out.select(*keys, *[F.col(f"t{a}").alias(a) for a in AXES], F.coalesce("m", F.lit(0)).alias("m"))


# ---- contours to cells --------------------------------------------------------------------------------------

def polygon_fill(points: DataFrame, keys=("region", "slice")) -> DataFrame:
    """(keys, y, x): cells inside or on the polygons given as ordered points (contour, ord, px, py).

    Vertices are cut to whole cells. Each edge is split into the rows it crosses; sorting a row's
    crossings pairs them into spans (even-odd rule per outline and row), then the cells on the edges
    are added. Outlines of one region and slice are drawn over each other.
    """
    from pyspark.sql import Window

    keys = list(keys)
    ring = Window.partitionBy(*keys, "contour").orderBy("ord")  # one drawn outline
    whole = Window.partitionBy(*keys, "contour").orderBy("ord").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    cut = lambda c: F.when(F.col(c) >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("int")
    e = points.select(*keys, "contour", "ord", cut("px").alias("x1"), cut("py").alias("y1"))
    e = e.withColumn("x2", F.coalesce(F.lead("x1").over(ring), F.first("x1").over(whole)))
    e = e.withColumn("y2", F.coalesce(F.lead("y1").over(ring), F.first("y1").over(whole)))
    # half-open in y, so a vertex is crossed once
    rows = e.where("y1 <> y2").withColumn("y", F.explode(F.sequence(F.least("y1", "y2"), F.greatest("y1", "y2") - 1)))
    at = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    rows = rows.select(*keys, "contour", "y", at.cast("double").alias("cx"))
    w = Window.partitionBy(*keys, "contour", "y").orderBy("cx")
    rows = rows.withColumns({"k": F.row_number().over(w), "nx": F.lead("cx").over(w)}).where("k % 2 = 1")
    span = rows.where(F.ceil("cx") <= F.floor("nx"))
    inside = span.select(*keys, "y", F.explode(F.sequence(F.ceil("cx").cast("int"), F.floor("nx").cast("int"))).alias("x"))
    n = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    edge = e.withColumn("n", n).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n"))))
    step = lambda a: (F.col(f"{a}1") + F.floor(F.coalesce(F.try_divide(
        (F.col(f"{a}2") - F.col(f"{a}1")) * F.col("t"), F.col("n")), F.lit(0.0)) + 0.5)).cast("int")
    on = edge.select(*keys, step("y").alias("y"), step("x").alias("x"))
    return inside.unionByName(on).distinct()
