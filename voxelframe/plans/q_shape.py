"""Shape queries: level regions, mesh, contour, diameters, eigenvalues."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.functions.names import snake
from voxelframe.operators import grid, mesh
from voxelframe.plans import sql
from voxelframe.plans.catalog import r6, register
from voxelframe.plans.q_texture import rounded
from voxelframe.sources import tables as T

BINS = (1, 2, 4, 8, 32, 64)   # fixed values: the full grid
SPACING = (2.0, 1.0, 1.0)
KG = "case_id, bin_count, g"
PI = "3.141592653589793"


def _roi(spark, d):
    return grid.roi(T.voxels3d_roi(spark, d))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


def mesh_cte(bins, spacing=(1.0, 1.0, 1.0)) -> str:
    corners = ", ".join(f"({1 << k}, {z}, {y}, {x})" for k, (z, y, x) in enumerate(mesh.CORNERS3))
    return f"""{sql.lev_cte(bins, T.SQL_VOX_ROI)},
cn(bit, dz, dy, dx) AS (VALUES {corners}),
tb(code, area, det, nz, ny, nx) AS (VALUES {_values(mesh.mesh_rows(spacing))}),
bx AS (SELECT case_id, min(z) AS z0, min(y) AS y0, min(x) AS x0 FROM roi GROUP BY case_id),
cu AS (SELECT {KG}, z - z0 + 1 - dz AS cz, y - y0 + 1 - dy AS cy, x - x0 + 1 - dx AS cx, sum(bit) AS code
       FROM lev JOIN bx USING (case_id), cn GROUP BY ALL),
sf AS (SELECT {KG}, sum(CAST(area AS DOUBLE)) AS area, sum(det + cz * nz + cy * ny + cx * nx) / 6.0 AS volume
       FROM cu JOIN tb USING (code) GROUP BY ALL),
lx AS (SELECT case_id, bin_count, CAST(unnest(range(1, max(g) + 1)) AS INT) AS g FROM lev GROUP BY case_id, bin_count),
av AS (SELECT lx.case_id, lx.bin_count, lx.g, coalesce(sf.area, 0.0)::DOUBLE AS area, coalesce(sf.volume, 0.0)::DOUBLE AS volume
       FROM lx LEFT JOIN sf USING ({KG}))"""


_Z = "CASE WHEN volume = 0 THEN 0 ELSE {} END"
_SHAPE = {
    "Volume": "volume", "SurfaceArea": "area", "SurfaceVolumeRatio": _Z.format("area / volume"),
    "Sphericity": _Z.format(f"pow(36 * {PI} * volume * volume, 1.0 / 3.0) / area"),
    "Compactness1": _Z.format(f"volume / (pow(area, 1.5) * sqrt({PI}))"),
    "Compactness2": _Z.format(f"36 * {PI} * volume * volume / pow(area, 3)"),
    "SphericalDisproportion": _Z.format(f"area / pow(36 * {PI} * volume * volume, 1.0 / 3.0)"),
}
for _name in mesh.SHAPE:
    register(f"shape_{snake(_name)}",
             lambda spark, d, n=_name: rounded(mesh.shape_features(_roi(spark, d), BINS, [n], SPACING)
                                               .withColumnRenamed(n, "value")),
             f"WITH {mesh_cte(BINS, SPACING)} SELECT {KG}, {r6(_SHAPE[_name])} AS value FROM av")


def _mesh3d(spark, d):
    roi = _roi(spark, d)
    return rounded(mesh.surface(roi.withColumn("bin_count", F.lit(1)).withColumn("g", F.lit(1)),
                                ["case_id", "bin_count", "g"], grid.bounding_box(roi)))


register("sh_mesh_3d", _mesh3d,
         f"WITH {mesh_cte((1,))} SELECT {KG}, {r6('area')} AS area, {r6('volume')} AS volume FROM sf")

register("sh_level_roi",
         lambda spark, d: grid.discretise_many(_roi(spark, d), (1, 2, 4, 8, 32, 64)).groupBy(
             "case_id", "bin_count", "g").agg(F.count(F.lit(1)).alias("cells")),
         f"WITH {sql.lev_cte((1, 2, 4, 8, 32, 64), T.SQL_VOX_ROI)} SELECT {KG}, count(*) AS cells FROM lev GROUP BY ALL")

# ---- planar ------------------------------------------------------------------------------------------

BINS2 = (1, 2, 4, 8, 32, 64)   # fixed values: the full grid


def contour_cte() -> str:
    corners = ", ".join(f"({1 << k}, {y}, {x})" for k, (y, x) in enumerate(mesh.CORNERS2))
    return f"""{sql.lev_cte(BINS2, T.SQL_VOX2D)},
cn(bit, dy, dx) AS (VALUES {corners}),
tb(code, len, det, ny, nx) AS (VALUES {_values(mesh.contour_rows((1.0, 2.0)))}),
sq AS (SELECT {KG}, y - dy AS cy, x - dx AS cx, sum(bit) AS code FROM lev, cn GROUP BY ALL),
ct AS (SELECT {KG}, sum(CAST(len AS DOUBLE)) AS perimeter, sum(det + cy * ny + cx * nx) / 2.0 AS surface
       FROM sq JOIN tb USING (code) GROUP BY ALL),
px AS (SELECT {KG}, count(*) * 2.0 AS pixels FROM lev GROUP BY ALL),
cv AS (SELECT * FROM ct JOIN px USING ({KG}))"""


def _contour(spark, d):
    lev = grid.discretise_many(T.voxels2d(spark, d), BINS2)
    return mesh.contour(lev, ["case_id", "bin_count", "g"], (1.0, 2.0))


register("sh_contour_2d", lambda spark, d: rounded(_contour(spark, d).select("case_id", "bin_count", "g", "perimeter", "surface")),
         f"WITH {contour_cte()} SELECT {KG}, {r6('perimeter')} AS perimeter, {r6('surface')} AS surface FROM cv")
_SHAPE2D = {
    "MeshSurface": "surface", "PixelSurface": "CAST(pixels AS DOUBLE)", "Perimeter": "perimeter",
    "PerimeterSurfaceRatio": "perimeter / surface", "Sphericity": f"2 * sqrt({PI} * surface) / perimeter",
    "SphericalDisproportion": f"perimeter / (2 * sqrt({PI} * surface))",
}
for _name in mesh.SHAPE2D:
    register(f"shape2d_{snake(_name)}",
             lambda spark, d, n=_name: rounded(_contour(spark, d).select(
                 "case_id", "bin_count", "g", mesh.contour_columns()[n].alias("value"))),
             f"WITH {contour_cte()} SELECT {KG}, {r6(_SHAPE2D[_name])} AS value FROM cv")

# ---- geometry ------------------------------------------------------------------------------------------

register("jn_max_pairwise_distance",
         lambda spark, d: rounded(mesh.mesh_diameters(_roi(spark, d), ["case_id"], SPACING)),
         f"""WITH {T.SQL_VOX_ROI}, roi AS (SELECT case_id, z, y, x FROM vox WHERE m = 1),
fc(dz, dy, dx) AS (VALUES (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1)),
vx AS (SELECT a.case_id, (a.z + dz * 0.5) * 2.0::DOUBLE AS z, (a.y + dy * 0.5)::DOUBLE AS y, (a.x + dx * 0.5)::DOUBLE AS x
       FROM (SELECT * FROM roi, fc) a LEFT JOIN roi b ON b.case_id = a.case_id AND b.z = a.z + a.dz AND b.y = a.y + a.dy
            AND b.x = a.x + a.dx WHERE b.case_id IS NULL),
pr AS (SELECT a.case_id, a.z AS az, a.y AS ay, a.x AS ax, b.z AS bz, b.y AS b_y, b.x AS bx,
              sqrt(pow(a.z - b.z, 2) + pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) AS d FROM vx a JOIN vx b USING (case_id))
SELECT case_id, 'all' AS kind, {r6('max(d)')} AS dist FROM pr GROUP BY case_id
UNION ALL SELECT case_id, 'z', {r6('max(d)')} FROM pr WHERE az = bz GROUP BY case_id
UNION ALL SELECT case_id, 'y', {r6('max(d)')} FROM pr WHERE ay = b_y GROUP BY case_id
UNION ALL SELECT case_id, 'x', {r6('max(d)')} FROM pr WHERE ax = bx GROUP BY case_id""")

_EIG = f"""WITH {T.SQL_VOX_ROI}, pc AS (SELECT case_id, z * 2.0::DOUBLE AS z, y::DOUBLE AS y, x::DOUBLE AS x FROM vox WHERE m = 1),
c AS (SELECT case_id, var_pop(z) AS a, var_pop(y) AS b, var_pop(x) AS d, covar_pop(z, y) AS e, covar_pop(z, x) AS f,
             covar_pop(y, x) AS g FROM pc GROUP BY case_id),
k AS (SELECT *, -(a + b + d) AS c2, a * b + a * d + b * d - e * e - f * f - g * g AS c1,
             -(a * b * d + 2 * e * f * g - a * g * g - b * f * f - d * e * e) AS c0 FROM c),
t AS (SELECT *, (c2 * c2 - 3 * c1) / 9 AS qq, (2 * c2 * c2 * c2 - 9 * c2 * c1 + 27 * c0) / 54 AS rr FROM k),
h AS (SELECT *, CASE WHEN qq <= 0 THEN 0 ELSE acos(greatest(-1.0, least(1.0, rr / sqrt(qq * qq * qq)))) END AS th FROM t),
ev AS (SELECT case_id, -2 * sqrt(greatest(qq, 0)) * cos(th / 3) - c2 / 3 AS u,
              -2 * sqrt(greatest(qq, 0)) * cos((th + 2 * pi()) / 3) - c2 / 3 AS v,
              -2 * sqrt(greatest(qq, 0)) * cos((th - 2 * pi()) / 3) - c2 / 3 AS w FROM h),
so AS (SELECT case_id, list_sort([u, v, w]) AS l FROM ev)
SELECT case_id, {r6('l[1]')} AS ev0, {r6('l[2]')} AS ev1, {r6('l[3]')} AS ev2 FROM so"""
register("agg_roi_eigenvalues", lambda spark, d: rounded(mesh.eigenvalues(_roi(spark, d), spacing=SPACING)), _EIG)
