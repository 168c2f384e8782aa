"""SQL text of the oracles, written apart from the DataFrame plans."""

from __future__ import annotations

from itertools import product

from voxelframe.plans.catalog import r6
from voxelframe.sources.tables import SQL_VOX

EPS = "2.220446049250313e-16"
K3 = "case_id, bin_count, dist"


def lev_cte(bins, vox: str = SQL_VOX, label: int = 1) -> str:
    """vox, rng, lev(case_id, bin_count, z, y, x, v, g): g counts the edges not above v."""
    vals = ", ".join(f"({b})" for b in bins)
    return f"""{vox},
roi AS (SELECT * FROM vox WHERE m = {label}),
rng AS (SELECT case_id, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
               CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM roi GROUP BY case_id),
lev AS (SELECT r.case_id, b.bin_count, r.z, r.y, r.x, r.v,
               CAST(len(list_filter(range(0, b.bin_count), lambda k: g.lo + k * ((g.hi - g.lo) / b.bin_count) <= r.v)) AS INT) AS g
        FROM roi r JOIN rng g USING (case_id) CROSS JOIN (VALUES {vals}) AS b(bin_count))"""


def off_cte(distances, bidirectional=False, planar=False) -> str:
    d = max(distances)
    half = "" if bidirectional else "AND (dz > 0 OR (dz = 0 AND (dy > 0 OR (dy = 0 AND dx > 0))))"
    flat = "AND dz = 0" if planar else ""
    want = ", ".join(map(str, distances))
    return f"""off AS (
  SELECT CAST(row_number() OVER (PARTITION BY dist ORDER BY dz DESC, dy DESC, dx DESC) - 1 AS INT) AS angle, *
  FROM (SELECT CAST(a AS INT) AS dz, CAST(b AS INT) AS dy, CAST(c AS INT) AS dx,
               CAST(greatest(abs(a), abs(b), abs(c)) AS INT) AS dist
        FROM range(-{d}, {d + 1}) t(a), range(-{d}, {d + 1}) u(b), range(-{d}, {d + 1}) w(c))
  WHERE dist IN ({want}) {half} {flat})"""


def glcm_cte(bins, distances, vox: str = SQL_VOX) -> str:
    """... cnt, sym, p(case_id, bin_count, dist, angle, i, j, n, p)."""
    return f"""{lev_cte(bins, vox)}, {off_cte(distances)},
cnt AS (SELECT a.case_id, a.bin_count, o.dist, o.angle, a.g AS i, b.g AS j, count(*) AS n
        FROM (SELECT * FROM lev, off) o
        JOIN lev a ON a.case_id = o.case_id AND a.bin_count = o.bin_count AND a.z = o.z AND a.y = o.y AND a.x = o.x
        JOIN lev b ON b.case_id = o.case_id AND b.bin_count = o.bin_count AND b.z = o.z + o.dz AND b.y = o.y + o.dy
             AND b.x = o.x + o.dx GROUP BY ALL),
sym AS (SELECT {K3}, angle, i, j, CAST(sum(n) AS BIGINT) AS n FROM (
          SELECT {K3}, angle, i, j, n FROM cnt UNION ALL SELECT {K3}, angle, j, i, n FROM cnt) GROUP BY ALL),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY {K3}, angle) AS p FROM sym),
pv AS (SELECT *, p AS p_origin, p * p AS p_sq, greatest(-p * log2(p), 0) AS p_en FROM p),
lv AS (SELECT case_id, bin_count, g, row_number() OVER (PARTITION BY case_id, bin_count ORDER BY g) AS r
       FROM (SELECT DISTINCT case_id, bin_count, g FROM lev)),
lk AS (SELECT case_id, bin_count, count(*) AS ngp, max(g) AS ng, avg(g) AS la, stddev_samp(g) AS sd FROM lv GROUP BY ALL),
pl AS (SELECT pv.*, a.r AS ri, b.r AS rj, lk.ngp, lk.ng, lk.la, lk.sd FROM pv JOIN lk USING (case_id, bin_count)
       JOIN lv a ON a.case_id = pv.case_id AND a.bin_count = pv.bin_count AND a.g = pv.i
       JOIN lv b ON b.case_id = pv.case_id AND b.bin_count = pv.bin_count AND b.g = pv.j)"""


def _avg(cte: str, source: str, cols: dict[str, str]) -> str:
    """Sum expressions per angle, then the mean over angles."""
    inner = ", ".join(f"{e} AS \"{n}\"" for n, e in cols.items())
    outer = ", ".join(f"{r6(f'avg(\"{n}\")')} AS \"{n}\"" for n in cols)
    return (f"WITH {cte}, ang AS (SELECT {K3}, angle, {inner} FROM {source} GROUP BY {K3}, angle)\n"
            f"SELECT {K3}, {outer} FROM ang GROUP BY {K3}")


SFX = ("origin", "sq", "en")


def _nd(w: str, nd: bool) -> str:
    return f"CASE WHEN i = j THEN 0 ELSE {w} END" if nd else w


def glcm_oracle(name: str, bins, distances) -> str:
    cte = glcm_cte(bins, distances)
    grid = lambda *more: product(SFX, (1, 0), *more)
    if name == "Contrast":
        return _avg(cte, "pv", {f"f_{s}": f"sum(p_{s} * (i - j) * (i - j))" for s in SFX})
    if name == "Average":
        return _avg(cte, "pv", {f"f_{s}": f"sum(p_{s} * i)" for s in SFX})
    if name == "Dissimilarity":
        return _avg(cte, "pv", {f"f_{s}": f"sum(p_{s} * abs(i - j))" for s in SFX})
    if name in ("Homogeneity1", "Homogeneity2"):
        den = "1.0 + abs(i - j)" if name.endswith("1") else "1.0 + (i - j) * (i - j)"
        return _avg(cte, "pv", {f"f_{s}_nd_{nd}": f"sum({_nd(f'p_{s} / ({den})', nd)})" for s, nd in grid()})
    if name == "Dmn":
        cols = {}
        for s, nd, k, inv in grid((1, 2), (0, 1)):
            w = f"(pow(abs(i - j), {k}) / pow(ng, {k}))"
            w = f"1.0 / (1.0 + {w})" if inv else w
            cols[f"f_{s}_nd_{nd}_power_{k}_inv_{inv}"] = f"sum(p_{s} * {_nd(w, nd)})"
        return _avg(cte, "pl", cols)
    if name == "Autocorrelation":
        return _avg(cte, "pv", {
            f"f_{s}_nd_{nd}_inv_{inv}": f"sum(p_{s} * {_nd('1.0 / (i * j)' if inv else '1.0 * i * j', nd)})"
            for s, nd, inv in grid((0, 1))})
    if name.startswith("Gaussian"):
        left, right = "((1 + ceil(ngp / 2.0)) / 2.0)", "((floor(ngp / 2.0) + 1 + ngp) / 2.0)"
        mu = {"Gaussian": ["la"], "GaussianLeftPolar": ["1"], "GaussianRightPolar": ["ngp"],
              "GaussianLeftFocus": [left], "GaussianRightFocus": [right],
              "Gaussian2Focus": [left, right], "Gaussian2Polar": ["1", "ngp"]}[name]
        cols = {}
        for s, nd, inv in grid((0, 1)):
            g = [f"(exp(-pow(ri - {m}, 2) / (2 * pow(sd, 2))) * exp(-pow(rj - {m}, 2) / (2 * pow(sd, 2))))" for m in mu]
            w = " + ".join(f"1.0 / {x}" if inv else x for x in g)
            cols[f"f_{s}_nd_{nd}_inv_{inv}"] = f"sum(CASE WHEN ngp = 1 THEN 0 ELSE p_{s} * ({_nd(w, nd)}) END)"
        return _avg(cte, "pl", cols)
    if name == "Cluster":
        rm = ", ".join(f"sum(i * p_{s}) OVER (PARTITION BY {K3}, angle, j) / ngp AS rm_{s}, "
                       f"sum(j * p_{s}) OVER (PARTITION BY {K3}, angle, i) / ngp AS cm_{s}" for s in SFX)
        cte += f", cl AS (SELECT *, {rm} FROM pl)"
        cols = {}
        for s, nd, k, inv in grid((1, 2, 3, 4), (0, 1)):
            w = f"pow(abs(i + j - rm_{s} - cm_{s}), {k})"
            w = f"1.0 / (CASE WHEN {w} = 0 THEN 1e-8 ELSE {w} END)" if inv else w
            cols[f"f_{s}_nd_{nd}_power_{k}_inv_{inv}"] = f"sum(p_{s} * ({_nd(w, nd)}))"
        return _avg(cte, "cl", cols)
    if name in ("Variance", "Correlation"):
        mu = ", ".join(f"sum(i * p_{s}) OVER (PARTITION BY {K3}, angle) AS mu_{s}" for s in SFX)
        cte += f", mm AS (SELECT *, {mu} FROM pv)"
        if name == "Variance":
            return _avg(cte, "mm", {f"f_{s}": f"sum(p_{s} * pow(i - mu_{s}, 2))" for s in SFX})
        a = ", ".join(f"sum(p_{s} * (i - mu_{s}) * (j - mu_{s})) AS c_{s}, sum(p_{s} * pow(i - mu_{s}, 2)) AS s_{s}"
                      for s in SFX)
        o = ", ".join(f"{r6(f'avg(c_{s}) / (CASE WHEN sum(s_{s}) = 0 THEN 1e-8 ELSE sum(s_{s}) END)')} AS f_{s}"
                      for s in SFX)
        return (f"WITH {cte}, aa AS (SELECT {K3}, angle, {a} FROM mm GROUP BY {K3}, angle) "
                f"SELECT {K3}, {o} FROM aa GROUP BY {K3}")
    if name.startswith(("Sum", "Difference")):
        k = "i + j" if name.startswith("Sum") else "abs(i - j)"
        cte += f", ms AS (SELECT {K3}, angle, {k} AS k, sum(p) AS p FROM p GROUP BY {K3}, angle, {k})"
        inv = "(CASE WHEN k = 0 THEN 0 ELSE 1.0 / k END)"
        if name.endswith("Average"):
            return _avg(cte, "ms", {"inv_0": "sum(k * p)", "inv_1": f"sum({inv} * p)"})
        if name.endswith("Energy"):
            return _avg(cte, "ms", {"inv_0": "sum(k * p * p)", "inv_1": f"sum({inv} * p * p)"})
        if name.endswith("Entropy"):
            return _avg(cte, "ms", {"value": f"-sum(p * log2(p + {EPS}))"})
        cte += (f", ea AS (SELECT {K3}, angle, -sum(p * log2(p + {EPS})) AS e FROM ms GROUP BY {K3}, angle), "
                f"et AS (SELECT {K3}, avg(e) AS et FROM ea GROUP BY {K3}), mt AS (SELECT * FROM ms JOIN et USING ({K3}))")
        return _avg(cte, "mt", {"inv_0": "sum(p * pow(k - et, 2))", "inv_1": "sum(p / pow(k - et, 2))"})
    if name in ("Imc1", "Imc2"):
        cte += (f", px AS (SELECT {K3}, angle, i, sum(p) AS px FROM p GROUP BY ALL), "
                f"py AS (SELECT {K3}, angle, j, sum(p) AS py FROM p GROUP BY ALL), "
                f"h0 AS (SELECT {K3}, angle, -sum(p * log2(p + {EPS})) AS hxy, -sum(p * log2(px * py + {EPS})) AS hxy1 "
                f"FROM p JOIN px USING ({K3}, angle, i) JOIN py USING ({K3}, angle, j) GROUP BY {K3}, angle), "
                f"hx AS (SELECT {K3}, angle, -sum(px * log2(px + {EPS})) AS hx FROM px GROUP BY ALL), "
                f"hy AS (SELECT {K3}, angle, -sum(py * log2(py + {EPS})) AS hy FROM py GROUP BY ALL), "
                f"h2 AS (SELECT {K3}, angle, -sum(px * py * log2(px * py + {EPS})) AS hxy2 "
                f"FROM px JOIN py USING ({K3}, angle) GROUP BY ALL)")
        if name == "Imc1":
            e = "CASE WHEN greatest(hx, hy) = 0 THEN 0 ELSE (hxy - hxy1) / greatest(hx, hy) END"
            src = f"h0 JOIN hx USING ({K3}, angle) JOIN hy USING ({K3}, angle)"
        else:
            e = "CASE WHEN hxy2 <= hxy THEN 0 ELSE sqrt(1 - exp(-2 * (hxy2 - hxy))) END"
            src = f"h0 JOIN h2 USING ({K3}, angle)"
        return f"WITH {cte} SELECT {K3}, {r6(f'avg({e})')} AS value FROM {src} GROUP BY {K3}"
    raise KeyError(name)


def dense_cte(bins, distances) -> str:
    """vals(case_id, bin_count, dist, v): every cell of the dense matrix over the angles that hold pairs."""
    return glcm_cte(bins, distances) + f""",
na AS (SELECT DISTINCT {K3}, angle FROM p),
vals AS (SELECT na.case_id, na.bin_count, na.dist, coalesce(p.p, 0.0) AS v
         FROM na JOIN lv a USING (case_id, bin_count) JOIN lv b USING (case_id, bin_count)
         LEFT JOIN p ON p.case_id = na.case_id AND p.bin_count = na.bin_count AND p.dist = na.dist
              AND p.angle = na.angle AND p.i = a.g AND p.j = b.g)"""


def stat_sql(cte: str, name: str, keys: str, percents=None) -> str:
    """SQL for one statistic of vals(keys, v)."""
    def one(expr, source="vals"):
        return f"WITH {cte} SELECT {keys}, {r6(expr)} AS value FROM {source} GROUP BY {keys}"

    def q(p):
        return f"quantile_cont(v, {p})"

    z = "(CASE WHEN v = 0 THEN 1.0 ELSE v END)"
    iqr = f"abs({q(0.75)} - {q(0.25)})"
    flat = {
        "Mean": "avg(v)", "Median": q(0.5), "GeoMean1": f"exp(avg(log2(abs{z})))",
        "GeoMean2": f"exp(avg(abs(log2(abs{z}))))", "HarmonicMean": f"count(*) / sum(1.0 / {z})",
        "Minimum": "min(v)", "Maximum": "max(v)", "Range": "max(v) - min(v)", "Energy": "sum(v * v)",
        "RootMeanSquared": "sqrt(sum(v * v) / count(*))", "L2Norm": "sqrt(sum(v * v))",
        "25Percentile": q(0.25), "75Percentile": q(0.75), "InterquartileRange": iqr,
        "LowerNotch": f"{q(0.25)} - 1.5 * {iqr}", "UpperNotch": f"{q(0.75)} + 1.5 * {iqr}",
        "TrimMean": f"({q(0.25)} + {q(0.75)} + 2 * {q(0.5)}) / 4",
        "Variance": "var_pop(v)", "StandardDeviation": "stddev_pop(v)",
    }
    if name in flat:
        return one(flat[name])
    if name == "Deciles":
        parts = [f"SELECT {keys}, CAST({p} AS DOUBLE) AS percent, {r6(q(p / 100))} AS value FROM vals GROUP BY {keys}"
                 for p in percents]
        return f"WITH {cte} " + " UNION ALL ".join(parts)
    if name == "TrimmedMean":
        parts = [f"SELECT {keys}, CAST({p} AS DOUBLE) AS percent, "
                 f"{r6(f'avg(v) FILTER (rn > floor(n * CAST({p} AS DOUBLE)) AND rn <= n - floor(n * CAST({p} AS DOUBLE)))')} AS value "
                 f"FROM rk GROUP BY {keys}" for p in percents]
        return (f"WITH {cte}, rk AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY v) AS rn, "
                f"count(*) OVER (PARTITION BY {keys}) AS n FROM vals) " + " UNION ALL ".join(parts))
    if name == "Mode":
        return (f"WITH {cte}, vc AS (SELECT {keys}, v, count(*) AS n FROM vals GROUP BY {keys}, v), "
                f"rk AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, v) AS rn FROM vc) "
                f"SELECT {keys}, {r6('v')} AS value FROM rk WHERE rn = 1")
    if name in ("Uniformity", "Entropy"):
        e = "sum(q * q)" if name == "Uniformity" else f"-sum(q * log2(q + {EPS}))"
        return (f"WITH {cte}, vc AS (SELECT {keys}, v, count(*) AS n FROM vals GROUP BY {keys}, v), "
                f"pr AS (SELECT *, n / sum(n) OVER (PARTITION BY {keys}) AS q FROM vc) "
                f"SELECT {keys}, {r6(e)} AS value FROM pr GROUP BY {keys}")
    if name == "GeoMean3":
        cte += f", mn AS (SELECT *, min(v) OVER (PARTITION BY {keys}) AS lo FROM vals)"
        return one("exp(avg(ln(v + CASE WHEN lo <= 0 THEN abs(lo) + 1 ELSE 0 END)))", "mn")
    if name == "RobustMeanAbsoluteDeviation":
        cte += (f", pc AS (SELECT {keys}, {q(0.1)} AS a, {q(0.9)} AS b FROM vals GROUP BY {keys}), "
                f"kp AS (SELECT * FROM vals JOIN pc USING ({keys}) WHERE v BETWEEN a AND b), "
                f"mm AS (SELECT *, avg(v) OVER (PARTITION BY {keys}) AS mu FROM kp)")
        return one("avg(abs(v - mu))", "mm")
    if name in ("Skewness", "Kurtosis"):
        k, e = (3, 1.5) if name == "Skewness" else (4, 2)
        cte += f", mm AS (SELECT *, v - avg(v) OVER (PARTITION BY {keys}) AS d FROM vals)"
        return one(f"CASE WHEN avg(d * d) = 0 THEN 0 ELSE avg(pow(d, {k})) / pow(avg(d * d), {e}) END", "mm")
    mid = "avg(v)" if name.endswith("Mean") else q(0.5)
    cte += (f", md AS (SELECT {keys}, {mid} AS mid FROM vals GROUP BY {keys}), "
            f"dv AS (SELECT {keys}, abs(v - mid) AS v FROM vals JOIN md USING ({keys}))")
    if name.startswith("MeanAbsolute"):
        return one("avg(v)", "dv")
    if name.startswith("MaxAbsolute"):
        return one("max(v)", "dv")
    if name == "MedianAbsoluteDeviation":
        return one(f"1.4826 * {q(0.5)}", "dv")
    return one(q(0.5), "dv")


STATS = ("Mean", "Median", "Mode", "GeoMean1", "GeoMean2", "GeoMean3", "RobustMeanAbsoluteDeviation", "HarmonicMean",
         "TrimmedMean", "TrimMean", "MeanAbsoluteDeviationMean", "MeanAbsoluteDeviationMedian",
         "MedianAbsoluteDeviationFromMean", "MedianAbsoluteDeviationFromMedian", "MaxAbsoluteDeviationFromMean",
         "MaxAbsoluteDeviationFromMedian", "MedianAbsoluteDeviation", "RootMeanSquared", "Minimum", "Maximum",
         "25Percentile", "75Percentile", "InterquartileRange", "LowerNotch", "UpperNotch", "Range", "Deciles",
         "Variance", "StandardDeviation", "Skewness", "Kurtosis", "Energy", "Uniformity", "Entropy")
