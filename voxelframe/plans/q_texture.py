"""Co-occurrence and first-order queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.names import snake
from voxelframe.functions.numeric import r6 as rnd
from voxelframe.operators import cooccurrence as co
from voxelframe.operators import grid, texture, weighted
from voxelframe.plans import sql
from voxelframe.plans.catalog import r6, register
from voxelframe.sources import tables as T

BINS, DISTS = ALL_BINS, ALL_DISTS = (2, 4, 8, 32, 64), (1, 2, 3)   # fixed values: the full parameter grid
DENSE_BINS, DENSE_DISTS = (2, 4, 8), ALL_DISTS
TABLE_BINS, TABLE_DISTS = (2, 4, 8), (1,)   # of the queries that return whole matrices, cell by cell
TRIMS = (0.025, 0.05, 0.1, 0.25)
DECILES = tuple(range(10, 100, 10))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[rnd(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`")
                       for c, t in df.dtypes])


def _region(spark, d):
    return grid.roi(T.voxels3d(spark, d))


# ---- co-occurrence ------------------------------------------------------------------------------

for _name in co.FORMULAS:
    register(f"glcm_{snake(_name)}",
             lambda spark, d, n=_name: rounded(co.feature(n, _region(spark, d), BINS, DISTS)),
             sql.glcm_oracle(_name, BINS, DISTS))


_MU = ", ".join(f"sum(i * p_{s}) OVER (PARTITION BY {sql.K3}, angle) AS mu_{s}" for s in sql.SFX)
register("glcm_covariance",
         lambda spark, d: rounded(co.covariance(co.with_variants(texture.normalise(
             texture.glcm_counts(_region(spark, d), BINS, DISTS, totals=True))))),
         sql._avg(f"{sql.glcm_cte(BINS, DISTS)}, mm AS (SELECT *, {_MU} FROM pv)", "mm",
                  {f"f_{s}": f"sum(p_{s} * (i - mu_{s}) * (j - mu_{s}))" for s in sql.SFX}))


def stat_query(vw: DataFrame, keys, name: str, small: bool = False) -> DataFrame:
    if name in ("TrimmedMean", "Deciles"):
        direct = small and name == "Deciles"
        r = vw if direct else weighted.ranked(vw, keys, spread=small)
        q = weighted.percentile if direct else weighted.quantile
        ps = TRIMS if name == "TrimmedMean" else DECILES
        wide = r.groupBy(*keys).agg(*[weighted.ordered(name, p, q).alias(f"c{k}") for k, p in enumerate(ps)])
        arr = F.array(*[F.struct(F.lit(float(p)).alias("percent"), F.col(f"c{k}").alias("value"))
                        for k, p in enumerate(ps)])
        return rounded(wide.select(*keys, F.explode(arr).alias("t")).select(*keys, "t.percent", "t.value"))
    return rounded(weighted.statistic(vw, keys, name, small=small))


for _name in sql.STATS:
    if _name in ("RobustMeanAbsoluteDeviation", "Variance"):
        continue
    register(f"glcm_{snake(_name)}",
             lambda spark, d, n=_name: stat_query(co.dense(_region(spark, d), DENSE_BINS, DENSE_DISTS), co.KEYS, n, True),
             sql.stat_sql(sql.dense_cte(DENSE_BINS, DENSE_DISTS), _name, sql.K3,
                          TRIMS if _name == "TrimmedMean" else DECILES))


# ---- first order ---------------------------------------------------------------------------------

FO_KEYS = ["source", "case_id"]
FO_CTE = f"""{T.SQL_VOX},
vals AS (SELECT 'volume' AS source, case_id, v FROM vox
         UNION ALL SELECT 'group', l_suppkey, l_extendedprice / 1000.0 FROM lineitem)"""


def first_order_values(spark, d) -> DataFrame:
    vol = _region(spark, d).select(F.lit("volume").alias("source"), "case_id", "v")
    grp = T.groups1d(spark, d).select(F.lit("group").alias("source"), "case_id", (F.col("v") / 1000.0).alias("v"))
    return weighted.collapse(vol.unionByName(grp), FO_KEYS)


for _name in sql.STATS:
    if _name == "RootMeanSquared":
        continue
    register(f"fo_{snake(_name)}",
             lambda spark, d, n=_name: stat_query(first_order_values(spark, d), FO_KEYS, n),
             sql.stat_sql(FO_CTE, _name, "source, case_id", TRIMS if _name == "TrimmedMean" else DECILES))


def _rms(spark, d):
    vw = first_order_values(spark, d)
    return rounded(vw.groupBy(*FO_KEYS).agg(weighted.simple("RootMeanSquared").alias("rms"),
                                            weighted.simple("L2Norm").alias("l2norm")))


register("fo_root_mean_squared", _rms,
         f"WITH {FO_CTE} SELECT source, case_id, {r6('sqrt(avg(v * v))')} AS rms, {r6('sqrt(sum(v * v))')} AS l2norm "
         "FROM vals GROUP BY source, case_id")


# ---- matrices -------------------------------------------------------------------------------------

def _tx_offsets(spark, d):
    """Offsets usable in each volume: shorter than the axes it spans."""
    offs = spark.createDataFrame(grid.offsets(ALL_DISTS, bidirectional=True),
                                 "angle int, dist int, dz int, dy int, dx int")
    box = grid.bounding_box(T.voxels3d(spark, d))
    fits = [F.abs(F.col(f"d{a}")) <= F.col(f"{a}1") - F.col(f"{a}0") for a in ("z", "y", "x")]
    # a fixed table of 342 offsets goes to every box
    j = box.join(F.broadcast(offs), reduce(lambda a, b: a & b, fits))
    return j.select("case_id", "angle", "dist", "dz", "dy", "dx")


register("tx_offsets", _tx_offsets,
         f"""WITH {T.SQL_VOX}, {sql.off_cte(ALL_DISTS, bidirectional=True)},
box AS (SELECT case_id, max(z) - min(z) AS ez, max(y) - min(y) AS ey, max(x) - min(x) AS ex FROM vox GROUP BY case_id)
SELECT case_id, angle, dist, dz, dy, dx FROM box JOIN off ON abs(dz) <= ez AND abs(dy) <= ey AND abs(dx) <= ex""")

register("tx_glcm_counts",
         lambda spark, d: texture.glcm_counts(_region(spark, d), ALL_BINS, TABLE_DISTS, symmetric=False),
         f"WITH {sql.glcm_cte(ALL_BINS, TABLE_DISTS)} SELECT {sql.K3}, angle, i, j, n FROM cnt")

register("tx_glcm_prob",
         lambda spark, d: rounded(texture.normalise(texture.glcm_counts(_region(spark, d), TABLE_BINS, TABLE_DISTS)), 9),
         f"WITH {sql.glcm_cte(TABLE_BINS, TABLE_DISTS)} SELECT {sql.K3}, angle, i, j, n, {r6('p', 9)} AS p FROM p")

register("tx_glcm_variants",
         lambda spark, d: rounded(co.with_variants(texture.normalise(
             texture.glcm_counts(_region(spark, d), TABLE_BINS, TABLE_DISTS))), 9).drop("n"),
         f"WITH {sql.glcm_cte(TABLE_BINS, TABLE_DISTS)} SELECT {sql.K3}, angle, i, j, {r6('p', 9)} AS p, {r6('p_sq', 9)} AS p_sq, "
         f"{r6('p_en', 9)} AS p_en FROM pv")


def _marginals(spark, d):
    p = texture.normalise(texture.glcm_counts(_region(spark, d), TABLE_BINS, TABLE_DISTS))
    i, j = F.col("i"), F.col("j")
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), k.cast("int").alias("k"), x.cast("double").alias("w"))
                      for n, k, x in (("px", i, F.lit(1)), ("py", j, F.lit(1)), ("add", i + j, F.lit(1)),
                                      ("sub", F.abs(i - j), F.lit(1)), ("ux", F.lit(0), i), ("uy", F.lit(0), j))])
    t = p.withColumn("t", F.explode(kinds))
    m = t.groupBy(*co.KEYS, "angle", "t.kind", "t.k").agg(F.sum(F.col("p") * F.col("t.w")).alias("value"))
    h = p.groupBy(*co.KEYS, "angle").agg((-F.sum(co.plogp(F.col("p")))).alias("value"))
    return rounded(m.unionByName(h.select(*co.KEYS, "angle", F.lit("hxy").alias("kind"), F.lit(0).alias("k"), "value")))


register("tx_glcm_marginals", _marginals,
         f"""WITH {sql.glcm_cte(TABLE_BINS, TABLE_DISTS)}, u AS (
SELECT {sql.K3}, angle, 'px' AS kind, i AS k, sum(p) AS value FROM p GROUP BY ALL
UNION ALL SELECT {sql.K3}, angle, 'py', j, sum(p) FROM p GROUP BY ALL
UNION ALL SELECT {sql.K3}, angle, 'add', i + j, sum(p) FROM p GROUP BY ALL
UNION ALL SELECT {sql.K3}, angle, 'sub', abs(i - j), sum(p) FROM p GROUP BY ALL
UNION ALL SELECT {sql.K3}, angle, 'ux', 0, sum(i * p) FROM p GROUP BY ALL
UNION ALL SELECT {sql.K3}, angle, 'uy', 0, sum(j * p) FROM p GROUP BY ALL
UNION ALL SELECT {sql.K3}, angle, 'hxy', 0, -sum(p * log2(p + {sql.EPS})) FROM p GROUP BY ALL)
SELECT {sql.K3}, angle, kind, CAST(k AS INT) AS k, {r6('value')} AS value FROM u""")

SPACING = (2.0, 1.0, 1.0)
for _norm, _tag in (("infinity", "inf"), ("euclidean", "euc"), ("manhattan", "man"), ("no_weighting", "none")):
    _len = {"infinity": "greatest(2.0 * abs(dz), abs(dy), abs(dx))",
            "euclidean": "sqrt(4.0 * dz * dz + dy * dy + dx * dx)",
            "manhattan": "(2.0 * abs(dz) + abs(dy) + abs(dx))"}.get(_norm)
    _w = f"exp(-pow({_len}, 2))" if _len else "1.0"
    register(f"agg_angle_weight_{_tag}",
             lambda spark, d, n=_norm: rounded(texture.glcm_weighted(
                 texture.glcm_counts(_region(spark, d), TABLE_BINS, ALL_DISTS), n, ALL_DISTS, SPACING).select(*co.KEYS, "i", "j", "p"), 9),
             f"""WITH {sql.glcm_cte(TABLE_BINS, ALL_DISTS)},
cw AS (SELECT {sql.K3}, i, j, sum(n * {_w}) AS w FROM sym JOIN off USING (dist, angle) GROUP BY {sql.K3}, i, j)
SELECT {sql.K3}, i, j, {r6(f'w / sum(w) OVER (PARTITION BY {sql.K3})', 9)} AS p FROM cw""")
