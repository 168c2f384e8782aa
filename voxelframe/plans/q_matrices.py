"""Run length, dependence, neighbourhood difference, zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.functions.names import snake
from voxelframe.operators import components as cc
from voxelframe.operators import emphasis, grid, texture
from voxelframe.plans import sql
from voxelframe.plans.catalog import r6, register
from voxelframe.plans.q_texture import rounded
from voxelframe.sources import tables as T

BINS = (2, 4, 8, 32, 64)   # fixed values: the full grid
KEYS = ["case_id", "bin_count"]
K2 = "case_id, bin_count"
ROI = T.SQL_VOX_ROI


def levels(spark, d, bins=BINS):
    """Region with holes, so runs and neighbourhoods are broken by gaps."""
    return grid.discretise_many(grid.roi(T.voxels3d_roi(spark, d)), bins)


# ---- run length ------------------------------------------------------------------------------------

RUNS = f"""{sql.lev_cte(BINS, ROI)}, {sql.off_cte((1,))},
ln AS (SELECT {K2}, angle, g, CASE WHEN dz <> 0 THEN z WHEN dy <> 0 THEN y ELSE x END AS t, z, y, x, dz, dy, dx
       FROM lev, off),
lk AS (SELECT *, z - t * dz AS l0, y - t * dy AS l1, x - t * dx AS l2 FROM ln),
gi AS (SELECT *, t - row_number() OVER (PARTITION BY {K2}, angle, l0, l1, l2, g ORDER BY t) AS isl FROM lk),
rn AS (SELECT {K2}, angle, l0, l1, l2, g, isl, CAST(count(*) AS INT) AS len FROM gi GROUP BY ALL),
ok AS (SELECT DISTINCT {K2}, angle FROM (SELECT {K2}, angle, l0, l1, l2 FROM rn GROUP BY ALL HAVING sum(len) > 1)),
rl AS (SELECT {K2}, angle, g, len, count(*) AS n FROM rn JOIN ok USING ({K2}, angle) GROUP BY ALL)"""

register("win_runs",
         lambda spark, d: texture.runs(levels(spark, d)).groupBy(*KEYS, "angle", "l0", "l1", "l2", "g", "len").agg(
             F.count(F.lit(1)).alias("n")),
         f"WITH {RUNS} SELECT {K2}, angle, l0, l1, l2, g, len, count(*) AS n FROM rn GROUP BY ALL")
register("tx_glrlm_counts", lambda spark, d: texture.glrlm_counts(levels(spark, d)),
         f"WITH {RUNS} SELECT * FROM rl")


SPACING = (2.0, 1.0, 1.0)
for _norm, _tag, _len in (("infinity", "inf", "greatest(2.0 * abs(dz), abs(dy), abs(dx))"),
                          ("euclidean", "euc", "sqrt(4.0 * dz * dz + dy * dy + dx * dx)"),
                          ("manhattan", "man", "(2.0 * abs(dz) + abs(dy) + abs(dx))"), ("no_weighting", "none", "1.0")):
    register(f"agg_run_weight_{_tag}",
             lambda spark, d, n=_norm: rounded(texture.glrlm_weighted(texture.glrlm_counts(levels(spark, d)), n, SPACING).select(*KEYS, "g", "len", "n")),
             f"WITH {RUNS} SELECT {K2}, g, len, {r6(f'sum(n * {_len})')} AS n FROM rl JOIN off USING (angle) GROUP BY {K2}, g, len")


def _rl_marginals(spark, d):
    c = texture.glrlm_counts(levels(spark, d))
    t = c.withColumn("t", F.explode(F.array(
        F.struct(F.lit("pg").alias("kind"), F.col("g").alias("k")), F.struct(F.lit("pr").alias("kind"), F.col("len").alias("k")),
        F.struct(F.lit("nr").alias("kind"), F.lit(0).alias("k")))))
    return t.groupBy(*KEYS, "angle", "t.kind", "t.k").agg(F.sum("n").alias("n"))


register("tx_glrlm_marginals", _rl_marginals,
         f"""WITH {RUNS} SELECT {K2}, angle, 'pg' AS kind, g AS k, CAST(sum(n) AS BIGINT) AS n FROM rl GROUP BY ALL
UNION ALL SELECT {K2}, angle, 'pr', len, CAST(sum(n) AS BIGINT) FROM rl GROUP BY ALL
UNION ALL SELECT {K2}, angle, 'nr', 0, CAST(sum(n) AS BIGINT) FROM rl GROUP BY ALL""")


def _weight(name: str) -> str | None:
    """SQL weight of an emphasis feature."""
    if "NonUniformity" in name or not name.endswith("Emphasis"):
        return None
    w = "1.0"
    if name.startswith("Short") or name.startswith("Small"):
        w += " / (j * j)"
    if name.startswith("Long") or name.startswith("Large"):
        w += " * j * j"
    if "LowGray" in name:
        w += " / (g * g)"
    if "HighGray" in name:
        w += " * g * g"
    return w


def cell_oracle(cte: str, name: str, angle: bool) -> str:
    """Feature of mat(keys, [angle,] g, j, n), spelled out per feature."""
    u = f"{K2}, angle" if angle else K2
    tot = f", tt AS (SELECT {u}, sum(n) AS t FROM mat GROUP BY {u})"
    w = _weight(name)
    if w:
        body = f"SELECT {u}, sum(n * ({w})) / sum(n) AS f FROM mat GROUP BY {u}"
    elif name == "RunPercentage":
        body = f"SELECT {u}, sum(n) / sum(n * j) AS f FROM mat GROUP BY {u}"
    elif "NonUniformity" in name:
        by = "g" if name.startswith("Gray") else "j"
        den = "t * t" if name.endswith("Normalized") else "t"
        body = (f"SELECT {u}, sum(m * m) / any_value({den}) AS f FROM (SELECT {u}, {by}, CAST(sum(n) AS DOUBLE) AS m "
                f"FROM mat GROUP BY {u}, {by}) JOIN tt USING ({u}) GROUP BY {u}")
    elif name.endswith("Variance"):
        x = "g" if name.startswith("Gray") else "j"
        body = (f"SELECT {u}, sum(n / t * pow({x} - mu, 2)) AS f FROM mat JOIN tt USING ({u}) JOIN (SELECT {u}, "
                f"sum(n * {x}) / sum(n) AS mu FROM mat GROUP BY {u}) USING ({u}) GROUP BY {u}")
    else:
        body = f"SELECT {u}, -sum(n / t * log2(n / t + {sql.EPS})) AS f FROM mat JOIN tt USING ({u}) GROUP BY {u}"
    return f"WITH {cte}{tot}, ft AS ({body}) SELECT {K2}, {r6('avg(f)')} AS value FROM ft GROUP BY {K2}"


for _name in emphasis.RUN_LENGTH:
    register(f"glrlm_{snake(_name)}",
             lambda spark, d, n=_name: rounded(emphasis.cell_features(
                 texture.glrlm_counts(levels(spark, d)).withColumnRenamed("len", "j"), KEYS,
                 emphasis.run_length(), [n], angle=True).withColumnRenamed(n, "value")),
             cell_oracle(f"{RUNS}, mat AS (SELECT {K2}, angle, g, len AS j, n FROM rl)", _name, True))


# ---- dependence ------------------------------------------------------------------------------------

def neighbour_cte(bins, vox: str, planar: bool = False, alpha: int = 0) -> str:
    return f"""{sql.lev_cte(bins, vox)}, {sql.off_cte((1,), bidirectional=True, planar=planar)},
nb AS (SELECT a.case_id, a.bin_count, a.z, a.y, a.x, a.g, count(b.g) AS nb,
              count(CASE WHEN abs(a.g - b.g) <= {alpha} THEN 1 END) AS dep, sum(b.g) AS sg
       FROM (SELECT * FROM lev, off) a LEFT JOIN lev b ON b.case_id = a.case_id AND b.bin_count = a.bin_count
            AND b.z = a.z + a.dz AND b.y = a.y + a.dy AND b.x = a.x + a.dx
       GROUP BY a.case_id, a.bin_count, a.z, a.y, a.x, a.g)"""


GLDM = (f"{neighbour_cte(BINS, ROI)}, mat AS (SELECT {K2}, g, CAST(dep + 1 AS INT) AS j, count(*) AS n "
        f"FROM nb GROUP BY ALL)")


def _gldm(spark, d):
    return texture.gldm_counts(levels(spark, d))


register("tx_gldm_counts", _gldm, f"WITH {GLDM} SELECT {K2}, g, j AS dep, n FROM mat")


def _gldm_marginals(spark, d):
    t = _gldm(spark, d).withColumn("t", F.explode(F.array(
        F.struct(F.lit("pg").alias("kind"), F.col("g").alias("k")), F.struct(F.lit("pd").alias("kind"), F.col("dep").alias("k")),
        F.struct(F.lit("nz").alias("kind"), F.lit(0).alias("k")))))
    return t.groupBy(*KEYS, "t.kind", "t.k").agg(F.sum("n").alias("n"))


register("tx_gldm_marginals", _gldm_marginals,
         f"""WITH {GLDM} SELECT {K2}, 'pg' AS kind, g AS k, CAST(sum(n) AS BIGINT) AS n FROM mat GROUP BY ALL
UNION ALL SELECT {K2}, 'pd', j, CAST(sum(n) AS BIGINT) FROM mat GROUP BY ALL
UNION ALL SELECT {K2}, 'nz', 0, CAST(sum(n) AS BIGINT) FROM mat GROUP BY ALL""")

for _name in emphasis.DEPENDENCE:
    register(f"gldm_{snake(_name)}",
             lambda spark, d, n=_name: rounded(emphasis.cell_features(
                 _gldm(spark, d).withColumnRenamed("dep", "j"), KEYS, emphasis.dependence(), [n])
                 .withColumnRenamed(n, "value")),
             cell_oracle(GLDM, _name, False))


# ---- neighbourhood difference ----------------------------------------------------------------------

NGTDM = (f"{neighbour_cte(BINS, ROI)}, ng AS (SELECT {K2}, g, count(*) AS n, "
         f"sum(CASE WHEN nb = 0 THEN 0 ELSE abs(g - CAST(sg AS DOUBLE) / nb) END) AS s, "
         f"count(CASE WHEN nb > 0 THEN 1 END) AS n_valid FROM nb GROUP BY ALL), "
         f"co AS (SELECT *, n / sum(n) OVER (PARTITION BY {K2}) AS p, CAST(sum(n) OVER (PARTITION BY {K2}) AS BIGINT) AS nvp, "
         f"count(*) OVER (PARTITION BY {K2}) AS ngp, sum(s) OVER (PARTITION BY {K2}) AS sa FROM ng)")

register("tx_ngtdm_table", lambda spark, d: rounded(texture.ngtdm_table(levels(spark, d))),
         f"WITH {NGTDM} SELECT {K2}, g, n, {r6('s')} AS s, n_valid FROM ng")
register("tx_ngtdm_coef",
         lambda spark, d: rounded(emphasis.ngtdm_coefficients(texture.ngtdm_table(levels(spark, d)), KEYS).select(
             *KEYS, "g", "p", "s", "nvp", "ngp")),
         f"WITH {NGTDM} SELECT {K2}, g, {r6('p')} AS p, {r6('s')} AS s, nvp, ngp FROM co")

_PAIR = f"FROM co a JOIN co b USING ({K2}) GROUP BY {K2}"
_NG = {
    "Coarseness": f"SELECT {K2}, {r6('CASE WHEN sum(p * s) = 0 THEN 1e6 ELSE 1 / sum(p * s) END')} AS value FROM co GROUP BY {K2}",
    "Contrast": f"SELECT {K2}, {r6('CASE WHEN max(a.ngp) <= 1 THEN 0 ELSE sum(a.p * b.p * pow(a.g - b.g, 2)) * max(a.sa) / max(a.nvp) / (max(a.ngp) * (max(a.ngp) - 1)) END')} AS value {_PAIR}",
    "Busyness": f"SELECT {K2}, {r6('CASE WHEN sum(abs(a.g * a.p - b.g * b.p)) = 0 THEN 0 ELSE max(q.ps) / sum(abs(a.g * a.p - b.g * b.p)) END')} AS value FROM co a JOIN co b USING ({K2}) JOIN (SELECT {K2}, sum(p * s) AS ps FROM co GROUP BY ALL) q USING ({K2}) GROUP BY {K2}",
    "Complexity": f"SELECT {K2}, {r6('sum(abs(a.g - b.g) * (a.p * a.s + b.p * b.s) / (a.p + b.p)) / max(a.nvp)')} AS value {_PAIR}",
    "Strength": f"SELECT {K2}, {r6('CASE WHEN max(a.sa) = 0 THEN 0 ELSE sum((a.p + b.p) * pow(a.g - b.g, 2)) / max(a.sa) END')} AS value {_PAIR}",
}
for _name, _body in _NG.items():
    register(f"ngtdm_{snake(_name)}",
             lambda spark, d, n=_name: rounded(emphasis.ngtdm_features(texture.ngtdm_table(levels(spark, d)), KEYS)
                                               .select(*KEYS, F.col(n).alias("value"))),
             f"WITH {NGTDM} {_body}")


# ---- zones and components ----------------------------------------------------------------------------

def closure_cte(bins, vox: str, same: bool) -> str:
    """cm(keys, id, g, comp): smallest cell reachable over neighbour edges."""
    eq = "AND a.g = b.g" if same else ""
    return f"""{sql.lev_cte(bins, vox)},
c AS (SELECT {K2}, z * 10000 + y * 100 + x AS id, z, y, x, g FROM lev),
e AS (SELECT a.case_id, a.bin_count, a.id AS u, b.id AS w FROM c a JOIN c b ON a.case_id = b.case_id
      AND a.bin_count = b.bin_count AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 {eq}),
r AS (SELECT {K2}, u, w FROM e UNION SELECT r.case_id, r.bin_count, r.u, e.w FROM r JOIN e
      ON e.case_id = r.case_id AND e.bin_count = r.bin_count AND e.u = r.w),
cm AS (SELECT r.case_id, r.bin_count, r.u AS id, min(r.w) AS comp, any_value(c.g) AS g
       FROM r JOIN c ON c.case_id = r.case_id AND c.bin_count = r.bin_count AND c.id = r.u GROUP BY ALL)"""


def _short_id(col):
    """cell id back to z * 10000 + y * 100 + x"""
    m = F.lit(2097151)
    z = F.shiftright(col, 42) - 1048576
    y = F.shiftright(col, 21).bitwiseAND(m) - 1048576
    x = col.bitwiseAND(m) - 1048576
    return z * 10000 + y * 100 + x


register("tx_glszm_zones", lambda spark, d: cc.zone_counts(levels(spark, d)),
         f"WITH RECURSIVE {closure_cte(BINS, ROI, True)}, zs AS (SELECT {K2}, comp, g, CAST(count(*) AS INT) AS size FROM cm "
         f"GROUP BY ALL) SELECT {K2}, g, size, count(*) AS n FROM zs GROUP BY ALL")


def _components(spark, d):
    c = cc.components(grid.roi(T.voxels3d_roi(spark, d)).where("v > 0.1").select("case_id", "z", "y", "x"))
    return c.select("case_id", "z", "y", "x", _short_id(F.col("comp")).cast("long").alias("comp"))


register("vx_components", _components,
         f"WITH RECURSIVE {closure_cte((1,), T.SQL_VOX.replace('1 AS m', 'CASE WHEN CAST(e AS DOUBLE) > 0.1 THEN 1 ELSE 0 END AS m'), False)} "
         "SELECT case_id, CAST(id // 10000 AS INT) AS z, CAST((id // 100) % 100 AS INT) AS y, CAST(id % 100 AS INT) AS x, "
         "CAST(comp AS BIGINT) AS comp FROM cm")
