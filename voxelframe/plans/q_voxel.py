"""Voxel-table image operators and region predicates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from voxelframe.operators import filters as fl
from voxelframe.operators import extract, grid, recursive
from voxelframe.plans import sql
from voxelframe.plans.catalog import r6, register
from voxelframe.plans.q_texture import rounded
from voxelframe.sources import tables as T

C = "case_id, z, y, x"
VOX, ROI = T.SQL_VOX, T.SQL_VOX_ROI
# a sparser region, so that boxes, thresholds and clamping matter
HOT = VOX.replace("1 AS m", "CASE WHEN CAST(e AS DOUBLE) > 0.2 THEN 1 ELSE 0 END AS m")


def hot(spark, d):
    return T.voxels3d(spark, d).withColumn("m", F.when(F.col("v") > 0.2, 1).otherwise(0))


# ---- predicates and boxes ----------------------------------------------------------------------------

register("flt_roi", lambda spark, d: rounded(grid.roi(T.voxels3d_roi(spark, d)).drop("m")),
         f"WITH {ROI} SELECT {C}, {r6('v')} AS v FROM vox WHERE m = 1")
register("flt_min_mask",
         lambda spark, d: T.voxels3d(spark, d).withColumn("m", F.when(F.col("v") > 0.1, 1).otherwise(0)).groupBy(
             "case_id").agg(F.sum("m").alias("size")).where("size > 10"),
         f"WITH {HOT.replace('0.2', '0.1')} SELECT case_id, CAST(sum(m) AS BIGINT) AS size FROM vox GROUP BY case_id HAVING sum(m) > 10")


def _dims(spark, d, min_dims=2, min_size=5):
    box = grid.roi(hot(spark, d)).groupBy("case_id").agg(
        *[(F.max(a) - F.min(a) + 1).cast("long").alias(f"n{a}") for a in "zyx"], F.count(F.lit(1)).alias("size"))
    dims = sum((F.when(F.col(f"n{a}") > 1, 1).otherwise(0) for a in "yx"), F.when(F.col("nz") > 1, 1).otherwise(0))
    return box.where((dims >= min_dims) & (F.col("size") > min_size))


register("flt_roi_dims", _dims, f"""WITH {HOT}, b AS (SELECT case_id, CAST(max(z) - min(z) + 1 AS BIGINT) AS nz,
CAST(max(y) - min(y) + 1 AS BIGINT) AS ny, CAST(max(x) - min(x) + 1 AS BIGINT) AS nx, count(*) AS size FROM vox WHERE m = 1 GROUP BY case_id)
SELECT * FROM b WHERE (nz > 1)::INT + (ny > 1)::INT + (nx > 1)::INT >= 2 AND size > 5""")


def _in_image(spark, d):
    """The region's physical box inside the image's, tolerance 1e-3; masks of some cases are shifted."""
    ends = [f"{a}{k}" for a in "zyx" for k in (0, 1)]
    image = grid.bounding_box(hot(spark, d)).select("case_id", *[F.col(c).alias(f"image_{c}") for c in ends])
    box = grid.bounding_box(grid.roi(hot(spark, d))).join(image, "case_id")
    shift = F.pmod("case_id", F.lit(3)) * 0.5
    inside = F.lit(True)
    for a in "zyx":
        inside = inside & (F.col(f"{a}0") + shift >= F.col(f"image_{a}0") - 0.001) & (F.col(f"{a}1") + shift <= F.col(f"image_{a}1") + 0.001)
    return box.select("case_id", inside.alias("inside"))


register("flt_roi_in_image", _in_image, f"""WITH {HOT}, b AS (SELECT case_id, (case_id % 3) * 0.5 AS s, min(z) AS z0, max(z) AS z1, min(y) AS y0,
max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM vox WHERE m = 1 GROUP BY case_id)
SELECT case_id, least(z0, y0, x0) + s >= -0.001 AND greatest(z1, y1, x1) + s <= 3.001 AS inside FROM b""")

_SEG = {"absolute": (0.05, 0.2, "0.05", "0.2"), "relative": (0.2, 0.8, "0.2 * top", "0.8 * top"),
        "sigma": (-1.0, 1.0, "mu - sd", "mu + sd")}
for _mode, (_a, _b, _lo, _hi) in _SEG.items():
    register(f"flt_resegment_{_mode}",
             lambda spark, d, m=_mode, a=_a, b=_b: rounded(fl.resegment(T.voxels3d_roi(spark, d), a, b, m).drop("m")),
             f"""WITH {ROI}, w AS (SELECT *, max(v) OVER (PARTITION BY case_id) AS top, avg(v) OVER (PARTITION BY case_id) AS mu,
stddev_pop(v) OVER (PARTITION BY case_id) AS sd FROM vox WHERE m = 1),
k AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS n FROM w WHERE v BETWEEN {_lo} AND {_hi})
SELECT {C}, {r6('v')} AS v FROM k WHERE n > 1""")

register("agg_bounding_box", lambda spark, d: grid.bounding_box(grid.roi(hot(spark, d))),
         f"""WITH {HOT} SELECT case_id, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1
FROM vox WHERE m = 1 GROUP BY case_id""")


def _centre(spark, d, spacing=(2.0, 1.0, 1.0), origin=(10.0, -5.0, 0.5)):
    c = grid.roi(hot(spark, d)).groupBy("case_id").agg(*[F.avg(a).alias(f"c{a}") for a in "zyx"])
    world = [(F.lit(o) + F.col(f"c{a}") * s).alias(f"w{a}") for a, s, o in zip("zyx", spacing, origin)]
    return rounded(c.select("*", *world))


register("agg_center_of_mass", _centre, f"""WITH {HOT}, c AS (SELECT case_id, avg(z) AS z, avg(y) AS y, avg(x) AS x FROM vox WHERE m = 1 GROUP BY case_id)
SELECT case_id, {r6('z')} AS cz, {r6('y')} AS cy, {r6('x')} AS cx, {r6('10 + 2 * z')} AS wz, {r6('y - 5')} AS wy, {r6('x + 0.5')} AS wx FROM c""")


def image_provenance(vox, keys=("case_id",)):
    """Order-free fingerprint, size and value summary of an image."""
    return vox.groupBy(*keys).agg(
        F.bit_xor(F.xxhash64("z", "y", "x", "v")).alias("fingerprint"),
        *[(F.max(a) - F.min(a) + 1).cast("long").alias(f"n{a}") for a in "zyx"],
        F.avg("v").alias("mean"), F.min("v").alias("minimum"), F.max("v").alias("maximum"))


register("agg_image_provenance",
         lambda spark, d: rounded(image_provenance(T.voxels3d(spark, d)).drop("fingerprint").withColumn(
             "dimensions", F.lit("3D"))),
         f"""WITH {VOX} SELECT case_id, '3D' AS dimensions, CAST(max(z) - min(z) + 1 AS BIGINT) AS nz, CAST(max(y) - min(y) + 1 AS BIGINT) AS ny,
CAST(max(x) - min(x) + 1 AS BIGINT) AS nx, {r6('avg(v)')} AS mean, {r6('min(v)')} AS minimum, {r6('max(v)')} AS maximum FROM vox GROUP BY case_id""")


def _mask_provenance(spark, d):
    from voxelframe.operators import components as cc
    cells = grid.roi(hot(spark, d))
    comp = cc.components(cells.select("case_id", "z", "y", "x")).groupBy("case_id").agg(
        F.countDistinct("comp").alias("volume_num"))
    out = cells.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("voxel_num"), *[F.avg(a).alias(f"c{a}") for a in "zyx"],
        *[f(a).alias(f"{a}{n}") for a in "zyx" for f, n in ((F.min, "0"), (F.max, "1"))],
        F.avg("v").alias("mean"), F.min("v").alias("minimum"), F.max("v").alias("maximum"))
    return rounded(out.join(comp, "case_id").withColumn("stage", F.lit("original")))


def _mask_oracle():
    from voxelframe.plans.q_matrices import closure_cte
    return f"""WITH RECURSIVE {closure_cte((1,), HOT, False)}, vn AS (SELECT case_id, count(DISTINCT comp) AS volume_num FROM cm GROUP BY case_id)
SELECT case_id, 'original' AS stage, count(*) AS voxel_num, any_value(volume_num) AS volume_num, {r6('avg(z)')} AS cz, {r6('avg(y)')} AS cy, {r6('avg(x)')} AS cx,
min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, {r6('avg(v)')} AS mean, {r6('min(v)')} AS minimum, {r6('max(v)')} AS maximum
FROM roi JOIN vn USING (case_id) GROUP BY case_id"""


register("agg_mask_provenance", _mask_provenance, _mask_oracle())


def _step_provenance(spark, d):
    """Long rows of image and mask as the composed extraction gives them; the fingerprint has no twin in SQL."""
    v = hot(spark, d)
    rows = extract.provenance_of_steps([("original", v, grid.roi(v), (2.0, 1.0, 1.0))])
    return rounded(rows.where("feature NOT LIKE '%Hash%'"))


def _step_oracle():
    from voxelframe.plans.q_matrices import closure_cte
    values = "avg(v) AS Mean, min(v) AS Minimum, max(v) AS Maximum, 2.0 AS Spacing_z, 1.0 AS Spacing_y, 1.0 AS Spacing_x"
    size = {k: ", ".join(f"max({a}) - min({a}) + 1 AS {k}{a}" for a in "zyx") for k in ("Size_", "BoundingBox_n")}
    box = ", ".join(f"min({a}) AS BoundingBox_{a}, avg({a}) AS CenterOfMassIndex_{a}, avg({a}) * {2 if a == 'z' else 1} AS CenterOfMass_{a}" for a in "zyx")
    return f"""WITH RECURSIVE {closure_cte((1,), HOT, False)}, vn AS (SELECT case_id, count(DISTINCT comp) AS volume_num FROM cm GROUP BY case_id),
im AS (SELECT case_id, COLUMNS(* EXCLUDE case_id)::DOUBLE FROM (SELECT case_id, 3 AS Dimensionality, {size["Size_"]}, {values} FROM vox GROUP BY case_id)),
mk AS (SELECT case_id, COLUMNS(* EXCLUDE case_id)::DOUBLE FROM (SELECT case_id, count(*) AS VoxelNum, any_value(volume_num) AS VolumeNum, {size["BoundingBox_n"]}, {box}, {values}
       FROM roi JOIN vn USING (case_id) GROUP BY case_id)),
ui AS (UNPIVOT im ON COLUMNS(* EXCLUDE case_id) INTO NAME nm VALUE val), um AS (UNPIVOT mk ON COLUMNS(* EXCLUDE case_id) INTO NAME nm VALUE val)
SELECT case_id, 'diagnostics' AS image_type, 'Image-original_' || nm AS feature, {r6('val')} AS value FROM ui
UNION ALL SELECT case_id, 'diagnostics', 'Mask-original_' || nm, {r6('val')} FROM um"""


register("agg_step_provenance", _step_provenance, _step_oracle())

# ---- geometry --------------------------------------------------------------------------------------------

FLAT = VOX.replace("(p - 1) // 16", "(p - 1) // 16").replace("((p - 1) // 4) % 4", "((p - 1) // 8) % 2").replace("(p - 1) % 4", "(p - 1) % 8")
register("vx_axis_permute",
         lambda spark, d: rounded(fl.axis_permute(T.unpack_volume(T.table(spark, d, "embeddings"), "vec_id", "embedding", 2, 8))),
         f"WITH {FLAT} SELECT case_id, x AS z, z AS y, y AS x, {r6('v')} AS v FROM vox")

for _key, _pad, _shift in (("vx_crop_roi", 0, True), ("vx_crop_pad", 1, False)):
    _o = [f"{a} - greatest({a}0 - {_pad}, 0) AS {a}" if _shift else a for a in "zyx"]
    _c = " AND ".join(f"{a} BETWEEN greatest({a}0 - {_pad}, 0) AND least({a}1 + {_pad}, 3)" for a in "zyx")
    register(_key, lambda spark, d, p=_pad, s=_shift: rounded(fl.crop(hot(spark, d), p, s)),
             f"""WITH {HOT}, b AS (SELECT case_id, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1
FROM vox WHERE m = 1 GROUP BY case_id) SELECT case_id, {', '.join(_o)}, {r6('v')} AS v, m FROM vox JOIN b USING (case_id) WHERE {_c}""")


def geometry(vox, spacing=(2.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0)):
    g = vox.groupBy("case_id").agg(*[(F.max(a) + 1).cast("int").alias(f"n{a}") for a in "zyx"])
    for a, s, o in zip("zyx", spacing, origin):
        g = g.withColumn(f"d{a}", F.lit(s)).withColumn(f"o{a}", F.lit(o))
    return g


def _regrid(spark, d):
    mask = hot(spark, d).drop("v")
    img = geometry(mask, (1.5, 0.75, 1.0), (0.5, 0.0, -1.0))
    return fl.mask_regrid(mask, geometry(mask, (2.0, 1.0, 1.0)), img)


register("vx_mask_regrid", _regrid, f"""WITH {HOT}, g AS (SELECT DISTINCT case_id, tz::INT AS tz, ty::INT AS ty, tx::INT AS tx FROM vox, range(0, 4) a(tz), range(0, 4) b(ty), range(0, 4) c(tx)),
s AS (SELECT *, floor((0.5 + 1.5 * tz) / 2.0 + 0.5) AS sz, floor(0.75 * ty + 0.5) AS sy, floor(tx - 1.0 + 0.5) AS sx FROM g)
SELECT s.case_id, tz AS z, ty AS y, tx AS x, coalesce(m, 0) AS m FROM s LEFT JOIN vox ON vox.case_id = s.case_id AND z = sz AND y = sy AND x = sx""")

NEW = (1.0, 0.8, 0.0)   # new spacing; 0 keeps the axis
_T = """tg AS (SELECT DISTINCT case_id, tz::INT AS tz, ty::INT AS ty, tx::INT AS tx, least(greatest((tz + 0.5) * 1.0 / 2.0 - 0.5, 0), 3) AS pz,
  least(greatest((ty + 0.5) * 0.8 / 1.0 - 0.5, 0), 3) AS py, tx * 1.0 AS px
  FROM vox, range(0, 8) a(tz), range(0, 5) b(ty), range(0, 4) c(tx))"""
register("vx_resample_nearest",
         lambda spark, d: rounded(fl.resample(hot(spark, d), geometry(hot(spark, d)), NEW, "nearest")),
         f"""WITH {HOT}, {_T} SELECT tg.case_id, tz AS z, ty AS y, tx AS x, {r6('v')} AS v, m FROM tg JOIN vox ON vox.case_id = tg.case_id
AND z = floor(pz + 0.5) AND y = floor(py + 0.5) AND x = floor(px + 0.5)""")
register("vx_resample_linear",
         lambda spark, d: rounded(fl.resample(hot(spark, d), geometry(hot(spark, d)), NEW, "linear")),
         f"""WITH {HOT}, {_T} SELECT tg.case_id, tz AS z, ty AS y, tx AS x,
{r6('sum(v * greatest(0, 1 - abs(z - pz)) * greatest(0, 1 - abs(y - py)) * greatest(0, 1 - abs(x - px)))')} AS v
FROM tg JOIN vox ON vox.case_id = tg.case_id AND abs(z - pz) < 1 AND abs(y - py) < 1 AND abs(x - px) < 1 GROUP BY ALL""")



def _spline_matrix(n: int, places) -> list[list[float]]:
    """Weights of the n cells at each place: a dense solve for the coefficients, mirrored at both ends."""
    fold = lambda j: 0 if n == 1 else min(j % (2 * n - 2), 2 * n - 2 - j % (2 * n - 2))
    weight = lambda x: 2 / 3 - x * x + abs(x) ** 3 / 2 if abs(x) < 1 else max(0.0, 2 - abs(x)) ** 3 / 6

    def rows(at):
        m = np.zeros((len(at), n))
        for r, p in enumerate(at):
            for j in range(math.floor(p) - 1, math.floor(p) + 3):
                m[r, fold(j)] += weight(p - j)
        return m

    return (rows(places) @ np.linalg.inv(rows(range(n)))).tolist()


def _spline_oracle():
    parts = []
    for a, m, d, s in (("z", 8, 2.0, 1.0), ("y", 5, 1.0, 0.8), ("x", 4, 1.0, 1.0)):
        w = _spline_matrix(4, [min(max((t + 0.5) * s / d - 0.5, 0.0), 3.0) for t in range(m)])
        parts.append(f"s{a}(t{a}, {a}, w{a}) AS (VALUES {', '.join(f'({t}, {k}, {w[t][k]!r}::DOUBLE)' for t in range(m) for k in range(4))})")
    return (f"WITH {HOT}, {', '.join(parts)} SELECT case_id, tz AS z, ty AS y, tx AS x, {r6('sum(v * wz * wy * wx)')} AS v "
            "FROM vox JOIN sz USING (z) JOIN sy USING (y) JOIN sx USING (x) GROUP BY ALL")


register("vx_resample_spline",
         lambda spark, d: rounded(fl.resample(hot(spark, d), geometry(hot(spark, d)), NEW, "spline")), _spline_oracle())

# ---- discretisation ---------------------------------------------------------------------------------------

register("vx_bin_count",
         lambda spark, d: grid.discretise_many(grid.roi(T.voxels3d_roi(spark, d)), (2, 4, 8, 32, 64)).drop("v", "m"),
         f"WITH {sql.lev_cte((2, 4, 8, 32, 64), ROI)} SELECT bin_count, {C}, g FROM lev")
register("vx_bin_width",
         lambda spark, d: grid.discretise_width(T.groups1d(spark, d), 2500.0).select("case_id", F.round("v", 2).alias("v"), "g"),
         f"WITH {T.SQL_GROUPS}, w AS (SELECT *, min(v) OVER (PARTITION BY case_id) AS lo FROM vox) "
         "SELECT case_id, round(v, 2) AS v, CAST(floor(v / 2500.0) - floor(lo / 2500.0) + 1 AS INT) AS g FROM w")


def bin_edges(cells, bins: int | None = None, width: float = 25.0, keys=("case_id",)):
    """Edges per case: bins + 1 even edges with the last raised by 1, or multiples of the width."""
    r = grid.case_range(cells, keys)
    flat = F.col("lo") == F.col("hi")
    if bins is not None:
        a = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
        b = F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))
        e = F.transform(F.sequence(F.lit(0), F.lit(bins)),
                        lambda k: F.when(k == bins, b + 1.0).otherwise(a + k * ((b - a) / float(bins))))
    else:
        first = F.col("lo") - F.pmod("lo", F.lit(width))
        n = F.ceil((F.col("hi") + 2 * width - first) / width).cast("int")
        e = F.transform(F.sequence(F.lit(0), n - 1), lambda k: first + k * width)
    return r.select(*keys, F.posexplode(e).alias("k", "edge"))


register("agg_bin_edges",
         lambda spark, d: rounded(bin_edges(grid.roi(T.voxels3d_roi(spark, d)), bins=8).withColumn("kind", F.lit("count"))
                                  .unionByName(bin_edges(T.groups1d(spark, d), width=2500.0).withColumn("kind", F.lit("width")))),
         f"""WITH {sql.lev_cte((1,), ROI)}, gr AS (SELECT l_suppkey AS case_id, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY ALL),
e1 AS (SELECT case_id, unnest(range(0, 9)) AS k, lo, hi FROM rng),
e2 AS (SELECT case_id, lo - lo % 2500 AS f, unnest(range(0, CAST(ceil((hi + 5000 - (lo - lo % 2500)) / 2500) AS BIGINT))) AS k FROM gr)
SELECT case_id, CAST(k AS INT) AS k, {r6('CASE WHEN k = 8 THEN hi + 1 ELSE lo + k * ((hi - lo) / 8) END')} AS edge, 'count' AS kind FROM e1
UNION ALL SELECT case_id, CAST(k AS INT), {r6('f + k * 2500.0')}, 'width' FROM e2""")

# ---- intensity filters --------------------------------------------------------------------------------------

_TOP = f"WITH {VOX}, t AS (SELECT *, max(abs(v)) OVER (PARTITION BY case_id) AS top FROM vox)"
for _key, _fn, _expr in (
        ("vx_square", fl.square, "pow(v / sqrt(top), 2)"),
        ("vx_squareroot", fl.square_root, "sign(v) * sqrt(abs(v) * top)"),
        ("vx_logarithm", fl.logarithm, "sign(v) * ln(abs(v) + 1) * top / ln(top + 1)"),
        ("vx_exponential", fl.exponential, "exp(v * ln(top) / top)")):
    register(_key, lambda spark, d, f=_fn: rounded(f(T.voxels3d(spark, d)).drop("m")),
             f"{_TOP} SELECT {C}, {r6(_expr)} AS v FROM t")
register("vx_original", lambda spark, d: rounded(T.voxels3d(spark, d).drop("m").withColumn("image_type", F.lit("original"))),
         f"WITH {VOX} SELECT {C}, {r6('v')} AS v, 'original' AS image_type FROM vox")
register("vx_normalize", lambda spark, d: rounded(fl.normalise(T.voxels3d(spark, d), 100.0, 1.5).drop("m")),
         f"""WITH {VOX}, t AS (SELECT *, avg(v) OVER (PARTITION BY case_id) AS mu, stddev_samp(v) OVER (PARTITION BY case_id) AS sd FROM vox)
SELECT {C}, {r6('100 * greatest(-1.5, least(1.5, (v - mu) / sd))')} AS v FROM t""")

# ---- neighbourhood filters ------------------------------------------------------------------------------------


def _shift(a, o):
    return f"least(greatest({a} + {o}, 0), 3)"


_G = []
for _k, _a in enumerate("zyx"):
    for _sgn, _t in ((1, "p"), (-1, "n")):
        _on = " AND ".join(f"{_t}{_a}.{b} = " + (_shift(f"o.{b}", _sgn) if b == _a else f"o.{b}") for b in "zyx")
        _G.append(f"JOIN vox {_t}{_a} ON {_t}{_a}.case_id = o.case_id AND {_on}")
register("vx_gradient", lambda spark, d: rounded(fl.gradient(T.voxels3d(spark, d), (2.0, 1.0, 1.0)).drop("m")),
         f"""WITH {VOX} SELECT o.case_id, o.z, o.y, o.x, {r6('sqrt(pow((pz.v - nz.v) / 4.0, 2) + pow((py.v - ny.v) / 2.0, 2) + pow((px.v - nx.v) / 2.0, 2))')} AS v
FROM vox o {' '.join(_G)}""")


def _pass(src, axis, taps, name, index):
    """One axis pass in SQL: sum of w * v at the shifted cell."""
    rows = ", ".join(f"({o}, {', '.join(repr(float(w)) for w in ws)})" for o, ws in taps)
    n = len(taps[0][1])
    ws = ", ".join(f"w{k}" for k in range(n))
    others = [c for c in "zyx" if c != axis]
    return (f"t_{name}(o, {ws}) AS (VALUES {rows}), "
            f"{name} AS (SELECT a.case_id, a.z, a.y, a.x, a.b, " +
            ", ".join(f"sum(s.v * CAST(t.w{k} AS DOUBLE)) AS v{k}" for k in range(n)) +
            f" FROM {src} a, t_{name} t JOIN {src} s ON s.case_id = a.case_id AND s.b = a.b AND " +
            " AND ".join(f"s.{c} = a.{c}" for c in others) + f" AND s.{axis} = {index('a.' + axis + ' + t.o')} GROUP BY ALL)")


def _wavelet_oracle():
    taps = fl.wavelet_taps()
    parts, src = [f"s0 AS (SELECT {C}, v, '' AS b FROM vox)"], "s0"
    for k, a in enumerate("xyz"):
        parts.append(_pass(src, a, taps, f"p{k}", lambda e: f"(({e}) % 4 + 4) % 4"))
        parts.append(f"s{k + 1} AS (SELECT {C}, v0 AS v, b || 'L' AS b FROM p{k} UNION ALL SELECT {C}, v1, b || 'H' FROM p{k})")
        src = f"s{k + 1}"
    return f"WITH {VOX}, {', '.join(parts)} SELECT {C}, {r6('v')} AS v, 'wavelet-' || b AS image_type FROM {src}"


register("vx_wavelet", lambda spark, d: rounded(fl.wavelet(T.voxels3d(spark, d)).drop("m")), _wavelet_oracle())


def _recursive_taps(sigma):
    poles, (g, h) = recursive.gaussian(sigma)
    k = np.arange(-recursive.reach(poles)[0], recursive.reach(poles)[0] + 1)
    return list(zip(k.tolist(), zip(recursive.response(poles, g, k).tolist(), recursive.response(poles, h, k).tolist())))


def _log_oracle(sigma=1.0, taps=None):
    if taps is None:
        g, h = fl.gaussian_taps(sigma, 1.0), dict(fl.gaussian_taps(sigma, 1.0, 2))
        taps = [(o, (w[0], h[o][0])) for o, w in g]
    parts, src = [f"s0 AS (SELECT {C}, v, '' AS b FROM vox)"], "s0"
    for k, a in enumerate("zyx"):
        parts.append(_pass(src, a, taps, f"p{k}", lambda e: f"least(greatest({e}, 0), 3)"))
        parts.append(f"s{k + 1} AS (SELECT {C}, v0 AS v, b || 'g' AS b FROM p{k} UNION ALL SELECT {C}, v1, b || 'd' FROM p{k})")
        src = f"s{k + 1}"
    return (f"WITH {VOX}, {', '.join(parts)} SELECT {C}, {r6('sum(v) * ' + repr(sigma * sigma))} AS v FROM {src} "
            f"WHERE b IN ('dgg', 'gdg', 'ggd') GROUP BY {C}")


register("vx_log_sigma", lambda spark, d: rounded(fl.log_sigma(T.voxels3d(spark, d), 1.0).drop("m")), _log_oracle())
for _sigma in (1, 3):
    register(f"vx_log_recursive_{_sigma}",
             lambda spark, d, s=float(_sigma): rounded(fl.log_sigma(T.voxels3d(spark, d), s, how="recursive").drop("m")),
             _log_oracle(float(_sigma), _recursive_taps(float(_sigma))))


def _lbp_oracle():
    cols = []
    for k in range(8):
        dy, dx = round(-math.sin(2 * math.pi * k / 8), 5), round(math.cos(2 * math.pi * k / 8), 5)
        cols.append(f"CASE WHEN coalesce(sum(n.v * greatest(0, 1 - abs(n.y - a.y - ({dy}::DOUBLE))) * greatest(0, 1 - abs(n.x - a.x - ({dx}::DOUBLE)))), 0) "
                    f"- a.v >= 0 THEN 1 ELSE 0 END AS b{k}")
    turns = " + ".join(f"abs(b{k} - b{(k + 1) % 8})" for k in range(8))
    ones = " + ".join(f"b{k}" for k in range(8))
    return (f"WITH {VOX}, b AS (SELECT a.case_id, a.z, a.y, a.x, {', '.join(cols)} FROM vox a JOIN vox n ON n.case_id = a.case_id AND n.z = a.z "
            f"AND abs(n.y - a.y) <= 1 AND abs(n.x - a.x) <= 1 GROUP BY a.case_id, a.z, a.y, a.x, a.v) "
            f"SELECT {C}, CAST(CASE WHEN {turns} <= 2 THEN {ones} ELSE 9 END AS DOUBLE) AS v FROM b")


register("vx_lbp2d", lambda spark, d: fl.lbp2d(T.voxels3d(spark, d)).drop("m"), _lbp_oracle())

# ---- polygons ------------------------------------------------------------------------------------------------

# fixed values: eight directions of a star-shaped outline
DIRS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def outlines(spark, d):
    """Eight star-shaped outlines per region from all 64 values; slices may be unknown (-1)."""
    e = T.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("region"), (F.col("label") % 4 - 1).cast("int").alias("slice"),
        F.posexplode("embedding").alias("k", "e"))
    r = 2 + F.floor(F.abs(F.col("e").cast("double")) * 20)
    dx = F.element_at(F.array(*[F.lit(a) for a, _ in DIRS]), F.col("k") % 8 + 1)
    dy = F.element_at(F.array(*[F.lit(b) for _, b in DIRS]), F.col("k") % 8 + 1)
    contour = F.floor(F.col("k") / 8).cast("int")
    return e.select("region", "slice", contour.alias("contour"), (F.col("k") % 8).alias("ord"),
                    (16.5 + contour * 4 + dx * r).alias("px"), (16.5 + dy * r).alias("py"))


register("vx_polygon_fill",
         lambda spark, d: fl.polygon_fill(outlines(spark, d).where("slice <> -1")),
         f"""WITH p0 AS (SELECT vec_id AS region, CAST(label % 4 - 1 AS INT) AS slice, unnest(embedding)::DOUBLE AS e, unnest(range(0, 64)) AS k FROM embeddings),
dr(i, dx, dy) AS (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(DIRS))}),
pt AS (SELECT region, slice, k // 8 AS c, k % 8 AS o, CAST(floor(16.5 + (k // 8) * 4 + dx * (2 + floor(abs(e) * 20))) AS INT) AS x,
              CAST(floor(16.5 + dy * (2 + floor(abs(e) * 20))) AS INT) AS y FROM p0 JOIN dr ON i = k % 8 WHERE slice <> -1),
eg AS (SELECT a.region, a.slice, a.c, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM pt a JOIN pt b ON a.region = b.region AND a.c = b.c AND b.o = (a.o + 1) % 8),
cr AS (SELECT region, slice, c, yy AS y, x1 + (yy - y1) * CAST(x2 - x1 AS DOUBLE) / (y2 - y1) AS cx FROM (SELECT *, unnest(range(least(y1, y2), greatest(y1, y2))) AS yy FROM eg WHERE y1 <> y2)),
px AS (SELECT DISTINCT region, slice, c, y, unnest(range(-40, 100)) AS x FROM cr),
inn AS (SELECT px.region, px.slice, px.y, px.x FROM px JOIN cr USING (region, slice, c, y) GROUP BY px.region, px.slice, px.c, px.y, px.x
        HAVING sum(CASE WHEN cx <= x THEN 1 ELSE 0 END) % 2 = 1 OR sum(CASE WHEN cx = x THEN 1 ELSE 0 END) > 0),
ed AS (SELECT region, slice, CAST(y1 + floor(CASE WHEN n = 0 THEN 0 ELSE (y2 - y1) * t::DOUBLE / n END + 0.5) AS INT) AS y,
              CAST(x1 + floor(CASE WHEN n = 0 THEN 0 ELSE (x2 - x1) * t::DOUBLE / n END + 0.5) AS INT) AS x
       FROM (SELECT *, greatest(abs(x2 - x1), abs(y2 - y1)) AS n, unnest(range(0, greatest(abs(x2 - x1), abs(y2 - y1)) + 1)) AS t FROM eg))
SELECT region, slice, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM inn UNION SELECT region, slice, y, x FROM ed""")
