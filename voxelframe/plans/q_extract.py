"""Extraction modes, plug-ins and failure isolation."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.functions import registry
from voxelframe.operators import cooccurrence as co
from voxelframe.operators import extract, filters, grid, texture
from voxelframe.plans import sql
from voxelframe.plans.catalog import ORACLES, r6, register
from voxelframe.plans.q_matrices import K2, RUNS
from voxelframe.plans.q_shape import mesh_cte
from voxelframe.plans.q_texture import rounded
from voxelframe.session import scratch_path, stage
from voxelframe.sources import sinks
from voxelframe.sources import tables as T

ROI = T.SQL_VOX_ROI
BINS, DISTS = (2, 4, 8), (1,)
# region cells of cases with more than 32 of them: some cases fall out
MIN = 32

BIG = ROI.replace("vox AS (", "v0 AS (", 1) + f""",
vox AS (SELECT * FROM v0 WHERE case_id IN (SELECT case_id FROM v0 WHERE m = 1 GROUP BY case_id HAVING count(*) > {MIN}))"""


def _param_grid(spark, d):
    """The whole parameter grid from one neighbour match."""
    cells = grid.roi(T.voxels3d(spark, d))
    return rounded(extract.glcm(cells, wanted=("Contrast",), dense=False))


register("ex_param_grid", _param_grid,
         f"""WITH {sql.glcm_cte(extract.BIN_COUNTS, extract.DISTANCES)},
a AS (SELECT {sql.K3}, angle, sum(p_origin * (i - j) * (i - j)) AS f_origin, sum(p_sq * (i - j) * (i - j)) AS f_sq, sum(p_en * (i - j) * (i - j)) AS f_en FROM pv GROUP BY {sql.K3}, angle),
m AS (SELECT {sql.K3}, avg(f_origin) AS f_origin, avg(f_sq) AS f_sq, avg(f_en) AS f_en FROM a GROUP BY {sql.K3}),
u AS (UNPIVOT m ON f_origin, f_sq, f_en INTO NAME nm VALUE val)
SELECT case_id, 'glcm_Contrast_b_' || bin_count || '_d_' || dist || '_' || nm AS feature, {r6('val')} AS value FROM u""")

PICK = ("firstorder_Mean", "firstorder_Median", "firstorder_Energy", "glrlm_ShortRunEmphasis_b_4", "shape_Volume_b_1_l_1",
        "glcm_Contrast_b_8_d_1_f_origin")


def _segment(spark, d):
    wanted = {"firstorder": ("Mean", "Median", "Energy"), "shape": ("Volume",), "glrlm": ("ShortRunEmphasis",), "glcm": ("Contrast",)}
    long = extract.segment(T.voxels3d_roi(spark, d), tuple(wanted), BINS, DISTS, min_cells=MIN, names=wanted)
    return long.where(F.col("feature").isin(*PICK))


def _seg_sql():
    roi = BIG
    return f"""{mesh_cte((1,)).replace(ROI, roi)}, 
fo AS (SELECT case_id, avg(v) AS mean, quantile_cont(v, 0.5) AS median, sum(v * v) AS energy FROM roi GROUP BY case_id)"""


_SEG = f"""SELECT case_id, 'firstorder_Mean' AS feature, mean AS value FROM fo UNION ALL SELECT case_id, 'firstorder_Median', median FROM fo
UNION ALL SELECT case_id, 'firstorder_Energy', energy FROM fo UNION ALL SELECT case_id, 'shape_Volume_b_1_l_1', volume FROM sf
UNION ALL SELECT * FROM (WITH {RUNS.replace(ROI, BIG)}, ra AS (SELECT {K2}, angle, sum(n / (len * len * 1.0)) / sum(n) AS f FROM rl WHERE bin_count = 4 GROUP BY {K2}, angle)
  SELECT case_id, 'glrlm_ShortRunEmphasis_b_4', avg(f) FROM ra GROUP BY case_id)
UNION ALL SELECT * FROM (WITH {sql.glcm_cte((8,), (1,), BIG)}, ca AS (SELECT {sql.K3}, angle, sum(p * (i - j) * (i - j)) AS f FROM p GROUP BY {sql.K3}, angle)
  SELECT case_id, 'glcm_Contrast_b_8_d_1_f_origin', avg(f) FROM ca GROUP BY case_id)"""
register("ex_segment", lambda spark, d: rounded(_segment(spark, d)),
         f"WITH {_seg_sql()}, sg AS ({_SEG}) SELECT case_id, feature, {r6('value')} AS value FROM sg")


def _batch(spark, d):
    """One wide row per case; cases without a usable region keep their keys."""
    return rounded(extract.wide(_segment(spark, d), T.targets(spark, d), PICK))


_W = ", ".join(f"{r6(f'max(value) FILTER (feature = {chr(39)}{p}{chr(39)})')} AS \"{p}\"" for p in PICK)
register("ex_batch", _batch,
         f"""WITH {_seg_sql()}, sg AS ({_SEG}) SELECT e.vec_id AS case_id, any_value(CAST(e.label AS BIGINT)) AS label, {_W}
FROM embeddings e LEFT JOIN sg ON sg.case_id = e.vec_id GROUP BY e.vec_id""")


def _failed(spark, d):
    cells = extract.usable(T.voxels3d_roi(spark, d), min_cells=MIN)
    f = cells.groupBy("case_id").agg(F.avg("v").alias("mean"))
    return rounded(T.targets(spark, d).join(f, "case_id", "left"))


register("ex_failed_cases_kept", _failed,
         f"""WITH {BIG} SELECT vec_id AS case_id, CAST(label AS BIGINT) AS label, {r6('mean')} AS mean FROM embeddings
LEFT JOIN (SELECT case_id, avg(v) AS mean FROM vox WHERE m = 1 GROUP BY case_id) ON case_id = vec_id""")


def _override(spark, d):
    """Three-valued masks; every third case asks for label 2, the others for the default."""
    v = T.voxels3d(spark, d).withColumn("m", F.when(F.col("v") > 0.1, 2).when(F.col("v") > 0, 1).otherwise(0))
    cases = T.targets(spark, d).select("case_id", F.when(F.col("case_id") % 3 == 0, 2).alias("label"))
    return rounded(extract.with_label(v, cases).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")))


register("ex_label_override", _override,
         f"""WITH {T.SQL_VOX}, l AS (SELECT *, CASE WHEN v > 0.1 THEN 2 WHEN v > 0 THEN 1 ELSE 0 END AS lab FROM vox)
SELECT case_id, count(*) AS n, {r6('avg(v)')} AS mean FROM l WHERE lab = CASE WHEN case_id % 3 = 0 THEN 2 ELSE 1 END GROUP BY case_id""")

def _two_maps(spark, d):
    found = extract.voxel_map(T.voxels3d_roi(spark, d), names={"firstorder": ("Mean",), "glcm": ("Contrast",)})
    return found.withColumn("feature", F.regexp_replace("feature", "_d_1_f_origin$", "")).where("feature IN ('firstorder_Mean', 'glcm_Contrast')")


register("ex_voxel_map_all", lambda spark, d: rounded(extract.voxel_map(T.voxels3d_roi(spark, d))))
register("ex_voxel_map", lambda spark, d: rounded(_two_maps(spark, d)),
         f"""WITH {sql.lev_cte((8,), ROI)}, {sql.off_cte((1,))},
ke AS (SELECT a.case_id, a.z, a.y, a.x, b.z AS bz, b.y AS b_y, b.x AS bx, b.v, b.g FROM lev a JOIN lev b ON a.case_id = b.case_id
       AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
mn AS (SELECT case_id, z, y, x, avg(v) AS value FROM ke GROUP BY ALL),
pr AS (SELECT k.case_id, k.z, k.y, k.x, o.angle, avg((k.g - q.g) * (k.g - q.g)) AS f FROM (SELECT * FROM ke, (SELECT angle, dz, dy, dx FROM off)) AS k
       JOIN off o ON o.angle = k.angle JOIN ke q ON q.case_id = k.case_id AND q.z = k.z AND q.y = k.y AND q.x = k.x
       AND q.bz = k.bz + o.dz AND q.b_y = k.b_y + o.dy AND q.bx = k.bx + o.dx GROUP BY ALL),
cn AS (SELECT case_id, z, y, x, avg(f) AS value FROM pr GROUP BY ALL),
al AS (SELECT case_id, z, y, x, unnest(['firstorder_Mean', 'glcm_Contrast']) AS feature FROM vox),
va AS (SELECT *, 'firstorder_Mean' AS feature FROM mn UNION ALL SELECT *, 'glcm_Contrast' FROM cn)
SELECT al.case_id, al.z, al.y, al.x, al.feature, {r6('coalesce(value, 0)')} AS value FROM al LEFT JOIN va USING (case_id, z, y, x, feature)""")


def _voxel_maps(spark, d):
    path = scratch_path(spark, "maps")
    sinks.write_voxel_maps(_two_maps(spark, d), path)
    return rounded(spark.read.parquet(path))


register("sink_voxel_maps", _voxel_maps, ORACLES["ex_voxel_map"])


GRID_CLASSES = ("firstorder", "glcm", "glrlm", "gldm", "ngtdm", "glszm")


def _image_grid(spark, d):
    """All ten image types x all classes of one image, all bin counts and distances; of co-occurrence two formulas.

    The derived images share one case key, so each class is one job for all of them.
    """
    cells = stage(grid.roi(stage(extract.image_types(T.voxels3d(spark, d)), "images")), "cells")
    out = extract.features(cells, extract.Settings(names={"glcm": ("Contrast", "Imc1")}), GRID_CLASSES)
    return rounded(out.select("case_id.case_id", "case_id.image_type", "feature", "value"))


register("ex_image_type_grid", _image_grid)



def _composed(spark, d):
    """Every step of the chain, on three image types (LoG and wavelet have queries of their own)."""
    s = extract.Settings(normalise=100.0, clip=3.0, spacing=(2.0, 1.0, 1.0), new_spacing=(1.0, 1.0, 1.0), resegment=(-250.0, None, "absolute"),
                         image_types=("original", "square", "gradient"), classes=("firstorder", "glrlm"), bin_counts=(8,))
    return rounded(extract.compose(T.voxels3d_roi(spark, d), s))


register("ex_composed", _composed)

# ---- plug-ins -----------------------------------------------------------------------------------------


@registry.feature("third_moment_ratio")
def _third():
    return F.avg(F.col("v") * F.col("v") * F.col("v")) / F.avg(F.abs(F.col("v")))


@registry.feature("spread")
def _spread():
    return F.max("v") - F.min("v")


@registry.feature("old_spread", deprecated=True)
def _old():
    return F.max("v")


@registry.feature("pair_difference", table="pairs")
def _pair():
    return F.avg(F.abs(F.col("i") - F.col("j")))


@registry.image_filter("negative")
def _negative(vox):
    return vox.withColumn("v", -F.col("v"))


def _registered(spark, d):
    cells = grid.roi(T.voxels3d_roi(spark, d))
    pairs = texture.glcm_counts(cells, (8,), (1,), symmetric=False)
    return rounded(registry.apply(cells, ["case_id"]).join(registry.apply(pairs, ["case_id"], "pairs"), "case_id"))


register("udf_registered_feature", _registered,
         f"""WITH {sql.glcm_cte((8,), (1,), ROI)}, a AS (SELECT case_id, avg(v * v * v) / avg(abs(v)) AS t, max(v) - min(v) AS s FROM roi GROUP BY case_id),
b AS (SELECT case_id, avg(abs(i - j)) AS q FROM cnt GROUP BY case_id)
SELECT case_id, {r6('t')} AS third_moment_ratio, {r6('s')} AS spread, {r6('q')} AS pair_difference FROM a JOIN b USING (case_id)""")
register("udf_registered_filter",
         lambda spark, d: rounded(T.voxels3d(spark, d).transform(registry.FILTERS["negative"]).transform(filters.square_root).drop("m")),
         f"""WITH {T.SQL_VOX}, t AS (SELECT *, max(abs(v)) OVER (PARTITION BY case_id) AS top FROM vox)
SELECT case_id, z, y, x, {r6('-sign(v) * sqrt(abs(v) * top)')} AS v FROM t""")


def _try_null(spark, d):
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") % 5).alias("q"), F.col("l_tax").alias("t"))
    return rounded(li.select("l_orderkey", "l_linenumber", registry.null_if_bad(F.try_divide(F.col("t"), F.col("q"))).alias("ratio"),
                             registry.null_if_bad(F.log("q")).alias("log"), registry.null_if_bad(F.exp(F.col("q") * 1000)).alias("exp")))


register("udf_try_null", _try_null,
         f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity % 5 AS q, l_tax AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, {r6('CASE WHEN q <> 0 THEN t / q END')} AS ratio, {r6('CASE WHEN q > 0 THEN ln(q) END')} AS log, CASE WHEN q = 0 THEN 1.0::DOUBLE END AS exp FROM l""")
