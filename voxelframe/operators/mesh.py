"""Surface mesh of a region from corner codes.

A cube's triangles depend only on which of its 8 corners are set, so nothing is meshed cell by cell:
cubes are counted per (key, code) together with the sums of their positions, and at most 254 rows per
key meet a generated table. With vertices at offset t + local, the signed volume of a triangle is
det(local) + t . N, so area, volume and perimeter all follow from the counts and position sums.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.operators import grid

# fixed values: corner order of a cube as (z, y, x) and of a square as (y, x)
CORNERS3 = ((0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0))
CORNERS2 = ((0, 0), (0, 1), (1, 1), (1, 0))


def _faces():
    """Corner cycles of the six faces, all turning the same way seen from outside."""
    out = []
    for axis, side in product(range(3), (0, 1)):
        u, v = [a for a in range(3) if a != axis]
        cycle = [(0, 0), (0, 1), (1, 1), (1, 0)]
        if (side == 1) != (axis == 1):
            cycle = cycle[::-1]
        face = []
        for a, b in cycle:
            c = [0, 0, 0]
            c[axis], c[u], c[v] = side, a, b
            face.append(CORNERS3.index(tuple(c)))
        out.append(face)
    return out


def _cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _sub(a, b):
    return tuple(x - y for x, y in zip(a, b))


def _dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def _area(tri):
    n = _cross(_sub(tri[1], tri[0]), _sub(tri[2], tri[0]))
    return 0.5 * math.sqrt(_dot(n, n))


def _loops(code: int):
    """Closed polygons of edge midpoints; on a face with two opposite set corners each is cut off alone."""
    follow = {}
    for face in _faces():
        for k in range(4):
            if code >> face[k] & 1 and not code >> face[k - 1] & 1:  # a run of set corners starts at k
                e = k
                while code >> face[(e + 1) % 4] & 1:
                    e += 1
                follow[frozenset((face[k - 1], face[k]))] = frozenset((face[e % 4], face[(e + 1) % 4]))
    loops = []
    while follow:
        start = next(iter(follow))
        loop, cur = [], start
        while cur in follow:
            loop.append(cur)
            cur = follow.pop(cur)
        loops.append([tuple((CORNERS3[a][d] + CORNERS3[b][d]) / 2.0 for d in range(3)) for a, b in map(tuple, loop)])
    return loops


def _triangles(code: int):
    """Fans over each polygon; of the possible fans the one with the largest area."""
    out = []
    for loop in _loops(code):
        fans = []
        for s in range(len(loop)):
            r = loop[s:] + loop[:s]
            fans.append([(r[0], r[k], r[k + 1]) for k in range(1, len(r) - 1)])
        out += max(fans, key=lambda f: (round(sum(map(_area, f)), 9), f))
    return out


@lru_cache(maxsize=None)
def mesh_rows(spacing=(1.0, 1.0, 1.0)):
    """(code, area, det, nz, ny, nx): a code with the last corner set is the negated complement."""
    rows = []
    for code in range(1, 255):
        flip = code >> 7 & 1
        base = code ^ 255 if flip else code
        sign = -1.0 if flip else 1.0
        area = det = 0.0
        nrm = [0.0, 0.0, 0.0]
        for tri in _triangles(base):
            a, b, c = (tuple(x * s for x, s in zip(p, spacing)) for p in tri)
            area += _area((a, b, c))
            det += sign * _dot(_cross(a, b), c)
            n = _cross(_sub(b, a), _sub(c, a))
            for d in range(3):
                nrm[d] += sign * n[d] * spacing[d]
        rows.append((code, area, det, *nrm))
    # orient outwards: the eight cubes around a single cell enclose a positive volume
    vol = 0.0
    for k, (dz, dy, dx) in enumerate(CORNERS3):
        _, _, det, nz, ny, nx = rows[(1 << k) - 1]
        vol += det + (-dz) * nz + (-dy) * ny + (-dx) * nx
    s = 1.0 if vol > 0 else -1.0
    return tuple((c, a, s * d, s * z, s * y, s * x) for c, a, d, z, y, x in rows)


@lru_cache(maxsize=None)
def contour_rows(spacing=(1.0, 1.0)):
    """(code, length, det, ny, nx) of a square: segments cut off each run of set corners."""
    rows = []
    for code in range(1, 15):
        length = det = ny = nx = 0.0
        for k in range(4):
            if code >> k & 1 and not code >> ((k - 1) % 4) & 1:
                e = k
                while code >> ((e + 1) % 4) & 1:
                    e += 1
                mid = lambda p, q: tuple((CORNERS2[p][d] + CORNERS2[q][d]) / 2.0 * spacing[d] for d in (0, 1))
                a, b = mid((k - 1) % 4, k), mid(e % 4, (e + 1) % 4)
                length += math.dist(a, b)
                det += a[0] * b[1] - b[0] * a[1]
                ny += (b[1] - a[1]) * spacing[0]
                nx += (a[0] - b[0]) * spacing[1]
        rows.append((code, length, det, ny, nx))
    return tuple(rows)


def corner_codes(cells: DataFrame, keys, planar: bool = False) -> DataFrame:
    """(keys, code, n, sz, sy, sx): cubes by corner code with the sums of their origins.

    Cells go to the blocks of the cubes they touch; the eight contributions are made after that
    exchange and summed inside the block.
    """
    keys = list(keys)
    axes = ("y", "x") if planar else ("z", "y", "x")
    corners = CORNERS2 if planar else CORNERS3
    df = cells.select(*keys, "z", "y", "x")
    for a in axes:
        lo, hi = F.shiftright(F.col(a) - 1, grid.BLOCK_BITS), F.shiftright(F.col(a), grid.BLOCK_BITS)
        df = df.withColumn(f"b{a}", F.explode(F.sequence(lo, hi)))
    if planar:
        df = df.withColumn("bz", F.col("z"))
    place = [*keys, "bz", "by", "bx"]
    df = df.repartition(grid.parallelism(cells), *place)
    arr = F.array(*[F.struct(F.lit(1 << k).alias("bit"), *[F.lit(o).alias(a) for a, o in zip(axes, off)])
                    for k, off in enumerate(corners)])
    df = df.withColumn("o", F.explode(arr))
    for a in axes:
        df = df.withColumn(f"c{a}", F.col(a) - F.col(f"o.{a}"))
        df = df.where(F.shiftright(F.col(f"c{a}"), grid.BLOCK_BITS) == F.col(f"b{a}"))
    if planar:
        df = df.withColumn("cz", F.col("z"))
    cube = df.groupBy(*place, "cz", "cy", "cx").agg(F.sum("o.bit").cast("int").alias("code"))
    return cube.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n"), F.sum("cz").alias("sz"),
                                           F.sum("cy").alias("sy"), F.sum("cx").alias("sx"))


def surface(cells: DataFrame, keys, box: DataFrame, box_keys=("case_id",), spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """(keys, area, volume); positions count from one cell before the region's box."""
    keys = list(keys)
    spark = cells.sparkSession
    tab = spark.createDataFrame([tuple(r) for r in mesh_rows(tuple(spacing))],
                                "code int, area double, det double, nz double, ny double, nx double")
    c = corner_codes(cells, keys).join(box.select(*box_keys, "z0", "y0", "x0"), list(box_keys))
    c = c.join(F.broadcast(tab), "code")  # 254 generated rows
    n = F.col("n")
    vol = n * F.col("det")
    for a in ("z", "y", "x"):
        vol = vol + (F.col(f"s{a}") - n * (F.col(f"{a}0") - 1)) * F.col(f"n{a}")
    return c.groupBy(*keys).agg(F.sum(n * F.col("area")).alias("area"), (F.sum(vol) / 6.0).alias("volume"))


def contour(cells: DataFrame, keys, spacing=(1.0, 1.0)) -> DataFrame:
    """(keys, perimeter, surface, pixels) of a planar region."""
    keys = list(keys)
    tab = cells.sparkSession.createDataFrame(
        [tuple(r) for r in contour_rows(tuple(spacing))], "code int, len double, det double, ny double, nx double")
    c = corner_codes(cells, keys, planar=True).join(F.broadcast(tab), "code")  # 14 generated rows
    area = F.col("n") * F.col("det") + F.col("sy") * F.col("ny") + F.col("sx") * F.col("nx")
    out = c.groupBy(*keys).agg(F.sum(F.col("n") * F.col("len")).alias("perimeter"), (F.sum(area) / 2.0).alias("surface"))
    px = cells.groupBy(*keys).agg((F.count(F.lit(1)) * F.lit(float(spacing[0] * spacing[1]))).alias("pixels"))
    return out.join(px, keys)


def shape_columns() -> dict:
    a, v, pi = F.col("area"), F.col("volume"), math.pi
    cube = F.pow(36.0 * pi * v * v, F.lit(1.0 / 3.0))
    zero = lambda e: F.when(v == 0, 0.0).otherwise(e)
    return {
        "Volume": v,
        "SurfaceArea": a,
        "SurfaceVolumeRatio": zero(F.try_divide(a, v)),
        "Sphericity": zero(F.try_divide(cube, a)),
        "Compactness1": zero(F.try_divide(v, F.pow(a, F.lit(1.5)) * math.sqrt(pi))),
        "Compactness2": zero(F.try_divide(36.0 * pi * v * v, a * a * a)),
        "SphericalDisproportion": zero(F.try_divide(a, cube)),
    }


def contour_columns() -> dict:
    p, s = F.col("perimeter"), F.col("surface")
    sph = F.try_divide(2.0 * F.sqrt(math.pi * s), p)
    return {"MeshSurface": s, "PixelSurface": F.col("pixels"), "Perimeter": p,
            "PerimeterSurfaceRatio": F.try_divide(p, s), "Sphericity": sph,
            "SphericalDisproportion": F.try_divide(F.lit(1.0), sph)}


SHAPE = ("Volume", "SurfaceArea", "SurfaceVolumeRatio", "Sphericity", "Compactness1", "Compactness2",
         "SphericalDisproportion")
SHAPE2D = ("MeshSurface", "PixelSurface", "Perimeter", "PerimeterSurfaceRatio", "Sphericity",
           "SphericalDisproportion")


def shape_features(cells: DataFrame, bin_counts, names=SHAPE, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Features of every level region 1..Ng of every bin count; a level without cells gives zeros."""
    keys = ["case_id", "bin_count", "g"]
    lev = grid.discretise_many(cells, bin_counts)
    s = surface(lev, keys, grid.bounding_box(cells), spacing=spacing)
    every = lev.groupBy("case_id", "bin_count").agg(F.max("g").alias("ng"))
    every = every.select("case_id", "bin_count", F.explode(F.sequence(F.lit(1), F.col("ng"))).alias("g"))
    s = every.join(s, keys, "left").fillna(0.0, ["area", "volume"])
    cols = shape_columns()
    return s.select(*keys, *[cols[n].alias(n) for n in names])


def vertices(cells: DataFrame, keys, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Mesh vertices: the midpoint between a set cell and each unset face neighbour."""
    keys = list(keys)
    offs = [(k, 1, *o) for k, o in enumerate(((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))]
    p = grid.neighbour_pairs(cells.select(*keys, "z", "y", "x", F.lit(1).alias("hit")), offs, carry=("hit",),
                             keys=keys, left=True).where("hit2 IS NULL")
    return p.select(*keys, *[((F.col(a) + F.col(f"{a}2")) * 0.5 * float(s)).alias(a)
                             for a, s in zip(("z", "y", "x"), spacing)])


def max_distance(points: DataFrame, keys, tiles: int = 8) -> DataFrame:
    """(keys, dist): exact largest distance, without forming all pairs.

    Only extremes of the axis lines can realise it. The spread along 13 directions gives a lower
    bound; tiles (at most tiles^3 per key) whose boxes cannot be that far apart are never paired.
    """
    keys = list(keys)
    axes = ("z", "y", "x")
    pts = points.select(*keys, *axes)
    ends = pts.groupBy(*keys, "z", "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    ends = ends.select(*keys, "z", "y", F.explode(F.array_distinct(F.array("a", "b"))).alias("x"))
    ends = ends.groupBy(*keys, "z", "x").agg(F.min("y").alias("a"), F.max("y").alias("b"))
    ends = ends.select(*keys, "z", F.explode(F.array_distinct(F.array("a", "b"))).alias("y"), "x")
    dirs = [o[2:] for o in grid.offsets((1,))]
    aggs = [f(a).alias(f"{a}{n}") for a in axes for f, n in ((F.min, "0"), (F.max, "1"))]
    pos = F.struct(*axes)
    for k, o in enumerate(dirs):
        proj = sum((F.col(a) * v for a, v in zip(axes, o)), F.lit(0.0))
        aggs += [F.min_by(pos, proj).alias(f"p{k}"), F.max_by(pos, proj).alias(f"q{k}")]
    box = ends.groupBy(*keys).agg(*aggs)
    d2 = lambda p, q: sum(((F.col(f"{p}.{a}") - F.col(f"{q}.{a}")) * (F.col(f"{p}.{a}") - F.col(f"{q}.{a}"))
                           for a in axes), F.lit(0.0))
    low = F.greatest(*[d2(f"p{k}", f"q{k}") for k in range(len(dirs))])
    box = box.select(*keys, *[f"{a}{n}" for a in axes for n in "01"], low.alias("low"))
    t = ends.join(box, keys)
    span = {a: F.when(F.col(f"{a}1") > F.col(f"{a}0"), F.col(f"{a}1") - F.col(f"{a}0")).otherwise(1.0) for a in axes}
    for a in axes:
        t = t.withColumn(f"t{a}", F.least(F.floor((F.col(a) - F.col(f"{a}0")) / span[a] * tiles), F.lit(tiles - 1)))
    tile = [*keys, "tz", "ty", "tx"]
    tb = t.groupBy(*tile).agg(F.max("low").alias("low"), *[f(a).alias(f"{a}{n}") for a in axes
                                                            for f, n in ((F.min, "_min"), (F.max, "_max"))])
    other = tb.drop("low").withColumnsRenamed({c: f"{c}_2" for c in tb.columns if c not in keys and c != "low"})
    up = F.lit(0.0)
    for a in axes:
        far = F.greatest(F.abs(F.col(f"{a}_max") - F.col(f"{a}_min_2")), F.abs(F.col(f"{a}_max_2") - F.col(f"{a}_min")))
        up = up + far * far
    first = F.struct("tz", "ty", "tx") <= F.struct(F.col("tz_2"), F.col("ty_2"), F.col("tx_2"))
    near = tb.join(other, keys).where(first & (up >= F.col("low") * (1 - 1e-12))).select(
        *tile, "tz_2", "ty_2", "tx_2")
    a = t.select(*tile, *axes)
    b = a.withColumnsRenamed({c: f"{c}_2" for c in ("tz", "ty", "tx", *axes)})
    pair = near.join(a, tile).join(b, [*keys, "tz_2", "ty_2", "tx_2"])
    sq = sum(((F.col(c) - F.col(f"{c}_2")) * (F.col(c) - F.col(f"{c}_2")) for c in axes), F.lit(0.0))
    return pair.groupBy(*keys).agg(F.sqrt(F.max(sq)).alias("dist"))


def mesh_diameters(cells: DataFrame, keys, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """(keys, kind, dist): overall, and within planes of equal z, y or x."""
    keys = list(keys)
    v = vertices(cells, keys, spacing)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), p.alias("plane")) for k, p in (
        ("all", F.lit(0.0)), ("z", F.col("z")), ("y", F.col("y")), ("x", F.col("x")))])
    v = v.withColumn("t", F.explode(kinds)).select(*keys, "t.kind", "t.plane", "z", "y", "x")
    return max_distance(v, [*keys, "kind", "plane"]).groupBy(*keys, "kind").agg(F.max("dist").alias("dist"))


def eigenvalues(cells: DataFrame, keys=("case_id",), spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Ascending eigenvalues of the population covariance of physical coordinates (closed form)."""
    keys = list(keys)
    c = {a: F.col(a) * float(s) for a, s in zip(("z", "y", "x"), spacing)}
    pairs = [("z", "z"), ("y", "y"), ("x", "x"), ("z", "y"), ("z", "x"), ("y", "x")]
    m = cells.groupBy(*keys).agg(*[F.covar_pop(c[p], c[q]).alias(p + q) for p, q in pairs])
    a, b, d, e, f, g = (F.col(p + q) for p, q in pairs)
    q = (a + b + d) / 3.0
    off = e * e + f * f + g * g
    p2 = ((a - q) * (a - q) + (b - q) * (b - q) + (d - q) * (d - q) + 2.0 * off) / 6.0
    m = m.withColumns({"q": q, "p": F.sqrt(p2)})
    p, q = F.col("p"), F.col("q")
    da, db, dd = a - q, b - q, d - q
    det = da * (db * dd - g * g) - e * (e * dd - g * f) + f * (e * g - db * f)
    r = F.least(F.greatest(F.coalesce(F.try_divide(det / 2.0, p * p * p), F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
    m = m.withColumn("phi", F.acos(r) / 3.0)
    big = q + 2.0 * p * F.cos("phi")
    small = q + 2.0 * p * F.cos(F.col("phi") + 2.0 * math.pi / 3.0)
    mid = 3.0 * q - big - small
    fix = lambda x: F.when((x < 0) & (x > -1e-10), 0.0).otherwise(x)
    return m.select(*keys, fix(small).alias("ev0"), fix(mid).alias("ev1"), fix(big).alias("ev2"))
