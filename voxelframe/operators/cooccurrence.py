"""Features of the co-occurrence matrix, one column per variant, averaged over the angles.

Input is the normalised sparse table of ``texture.normalise`` (placed by matrix key), so the per-angle
and per-key aggregates below run without another exchange. Column names carry the variant:
``f_<origin|sq|en>``, ``nd_<1|0>``, ``power_<k>``, ``inv_<1|0>``, ``p_<x>``.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.numeric import EPS, plogp, ratio
from voxelframe.operators import texture
from voxelframe.session import stage

KEYS = texture.KEYS
SUFFIXES = {"origin": "p", "sq": "p_sq", "en": "p_en"}
TRIMS = (0.025, 0.05, 0.10, 0.25)
DECILES = tuple(range(10, 100, 10))


def variant(**args) -> str:
    """Variant part of a feature name; ``value`` when there is none."""
    short = {"suffix": "f", "inverse": "inv", "percent": "p"}
    parts = []
    for k, v in args.items():
        parts += [short.get(k, k), str(int(v)) if isinstance(v, bool) else str(v)]
    return "_".join(parts) or "value"


def with_variants(p: DataFrame) -> DataFrame:
    """Add the squared and the entropy-term cell values."""
    return p.withColumns({"p_sq": F.col("p") * F.col("p"),
                          "p_en": F.greatest(-F.col("p") * F.log2("p"), F.lit(0.0))})


def with_levels(p: DataFrame, levels: DataFrame) -> DataFrame:
    """Add the level facts of the region (at most bin_count levels per row) and the 1-based ranks."""
    out = p.join(levels, ["case_id", "bin_count"])
    return out.withColumns({"ri": F.array_position("levels", F.col("i")).cast("double"),
                            "rj": F.array_position("levels", F.col("j")).cast("double")}).drop("levels")


def angle_mean(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Sum per angle, then mean over the angles that hold pairs."""
    names = list(cols)
    a = df.groupBy(*KEYS, "angle").agg(*[c.alias(n) for n, c in cols.items()])
    return a.groupBy(*KEYS).agg(*[F.avg(n).alias(n) for n in names])


# ---- weights on (i, j) --------------------------------------------------------------------------

# The variants are written as text: a few hundred columns built call by call take longer than most of their jobs.

def _gauss(mu: str, inverse: bool) -> str:
    """exp(-(x-mu)^2 / 2 sd^2) at both ranks; the centre uses levels, the position uses ranks. Its inverse is infinite
    where few high levels are present and the weight is below the smallest double."""
    g = f"exp(-((ri - {mu}) * (ri - {mu}) + (rj - {mu}) * (rj - {mu})) / (2.0D * lv_sd * lv_sd))"
    return f"if({g} = 0, double('Infinity'), 1.0D / {g})" if inverse else g


def _off_diagonal(weight: str, nd: bool) -> str:
    return f"if(i = j, 0.0D, {weight})" if nd else weight


def _centres() -> dict[str, list[str]]:
    g = "cast(ng_present AS double)"
    left = f"((1.0D + ceil({g} / 2.0D)) / 2.0D)"
    right = f"((floor({g} / 2.0D) + 1.0D + {g}) / 2.0D)"
    return {
        "Gaussian": ["lv_avg"],
        "GaussianLeftPolar": ["1.0D"],
        "GaussianRightPolar": [g],
        "GaussianLeftFocus": [left],
        "GaussianRightFocus": [right],
        "Gaussian2Focus": [left, right],
        "Gaussian2Polar": ["1.0D", g],
    }


GAUSSIANS = ("Gaussian", "GaussianLeftPolar", "GaussianRightPolar", "GaussianLeftFocus",
             "GaussianRightFocus", "Gaussian2Focus", "Gaussian2Polar")


def gaussian(name: str) -> dict[str, Column]:
    mus = _centres()[name]
    cols = {}
    for sfx, nd, inv in product(SUFFIXES, (True, False), (False, True)):
        w = _off_diagonal("(" + " + ".join(_gauss(m, inv) for m in mus) + ")", nd)
        cols[variant(suffix=sfx, nd=nd, inverse=inv)] = F.expr(f"sum({SUFFIXES[sfx]} * if(ng_present = 1, 0.0D, {w}))")
    return cols


def contrast() -> dict[str, Column]:
    d = F.col("i") - F.col("j")
    return {variant(suffix=s): F.sum(F.col(c) * d * d) for s, c in SUFFIXES.items()}


def average() -> dict[str, Column]:
    return {variant(suffix=s): F.sum(F.col(c) * F.col("i")) for s, c in SUFFIXES.items()}


def autocorrelation() -> dict[str, Column]:
    cols = {}
    for sfx, nd, inv in product(SUFFIXES, (True, False), (False, True)):
        w = "(1.0D / cast(i * j AS double))" if inv else "cast(i * j AS double)"
        cols[variant(suffix=sfx, nd=nd, inverse=inv)] = F.expr(f"sum({SUFFIXES[sfx]} * {_off_diagonal(w, nd)})")
    return cols


def dmn() -> dict[str, Column]:
    """Difference moment scaled by the highest level present."""
    cols = {}
    for s, nd, power, inv in product(SUFFIXES, (True, False), (1, 2), (False, True)):
        w = f"(pow(cast(abs(i - j) AS double), {power}.0D) / pow(cast(ng AS double), {power}.0D))"
        w = f"(1.0D / (1.0D + {w}))" if inv else w
        cols[variant(suffix=s, nd=nd, power=power, inverse=inv)] = F.expr(f"sum({SUFFIXES[s]} * {_off_diagonal(w, nd)})")
    return cols


def _moments(pv: DataFrame) -> DataFrame:
    aggs = []
    i, j = F.col("i").cast("double"), F.col("j").cast("double")
    for s, c in SUFFIXES.items():
        p = F.col(c)
        aggs += [F.sum(p).alias(f"{s}0"), F.sum(p * i).alias(f"{s}1"), F.sum(p * j).alias(f"{s}1j"),
                 F.sum(p * i * i).alias(f"{s}2"), F.sum(p * i * j).alias(f"{s}11")]
    return pv.groupBy(*KEYS, "angle").agg(*aggs)


def _var(s: str) -> Column:
    m = F.col(f"{s}1")
    return F.col(f"{s}2") - 2.0 * m * m + m * m * F.col(f"{s}0")


def _cov(s: str) -> Column:
    m = F.col(f"{s}1")
    return F.col(f"{s}11") - m * F.col(f"{s}1j") - m * m + m * m * F.col(f"{s}0")


def variance(pv: DataFrame) -> DataFrame:
    return _moments(pv).groupBy(*KEYS).agg(*[F.avg(_var(s)).alias(variant(suffix=s)) for s in SUFFIXES])


def correlation(pv: DataFrame) -> DataFrame:
    """Covariance of each angle over the variance summed over *all* angles, then the angle mean."""
    out = []
    for s in SUFFIXES:
        total = F.sum(_var(s))
        out.append((F.avg(_cov(s)) / F.when(total == 0, 1e-8).otherwise(total)).alias(variant(suffix=s)))
    return _moments(pv).groupBy(*KEYS).agg(*out)


def covariance(pv: DataFrame) -> DataFrame:
    """The numerator of the correlation: sum P (i - mu)(j - mu) per angle, then the mean."""
    return _moments(pv).groupBy(*KEYS).agg(*[F.avg(_cov(s)).alias(variant(suffix=s)) for s in SUFFIXES])


def with_cluster(pl: DataFrame) -> DataFrame:
    """Distance of i + j to the plain means of i*P over rows and j*P over columns.

    Both means are sums over one axis of the matrix, at most levels rows per angle; the cells look
    them up by hash in the partition they already share.
    """
    def side(by: str, other: str, tag: str) -> DataFrame:
        sums = [(F.sum(F.col(other) * F.col(c)) / F.first("ng_present")).alias(f"{tag}_{s}") for s, c in SUFFIXES.items()]
        return pl.groupBy(*KEYS, "angle", by).agg(*sums).hint("shuffle_hash")

    df = pl.join(side("j", "i", "rm"), [*KEYS, "angle", "j"]).join(side("i", "j", "cm"), [*KEYS, "angle", "i"])
    return df.withColumns({f"w_{s}": F.abs(F.col("i") + F.col("j") - F.col(f"rm_{s}") - F.col(f"cm_{s}")) for s in SUFFIXES})


def cluster() -> dict[str, Column]:
    aggs = {}
    for s, nd, power, inv in product(SUFFIXES, (True, False), (1, 2, 3, 4), (False, True)):
        w = "(" + " * ".join([f"w_{s}"] * power) + ")"
        w = f"(1.0D / if({w} = 0, 1e-8D, {w}))" if inv else w
        aggs[variant(suffix=s, nd=nd, power=power, inverse=inv)] = F.expr(f"sum({SUFFIXES[s]} * {_off_diagonal(w, nd)})")
    return aggs


# ---- marginals ----------------------------------------------------------------------------------

def difference_mass(pv: DataFrame) -> DataFrame:
    k = F.abs(F.col("i") - F.col("j")).cast("double").alias("k")
    return pv.groupBy(*KEYS, "angle", k).agg(*[F.sum(c).alias(c) for c in SUFFIXES.values()])


def sum_mass(p: DataFrame) -> DataFrame:
    return p.groupBy(*KEYS, "angle", (F.col("i") + F.col("j")).cast("double").alias("k")).agg(F.sum("p").alias("p"))


def _homogeneity(weight) -> dict[str, Column]:
    k = F.col("k")
    cols = {}
    for s, nd in product(SUFFIXES, (True, False)):
        w = weight(k)
        if nd:
            w = F.when(k == 0, 0.0).otherwise(w)
        cols[variant(suffix=s, nd=nd)] = F.sum(F.col(SUFFIXES[s]) * w)
    return cols


def homogeneity1() -> dict[str, Column]:
    return _homogeneity(lambda k: 1.0 / (1.0 + k))


def homogeneity2() -> dict[str, Column]:
    return _homogeneity(lambda k: 1.0 / (1.0 + k * k))


def dissimilarity() -> dict[str, Column]:
    return {variant(suffix=s): F.sum(F.col(c) * F.col("k")) for s, c in SUFFIXES.items()}


def _inv(k: Column) -> Column:
    return F.when(k == 0, 0.0).otherwise(1.0 / F.when(k == 0, 1.0).otherwise(k))


def mass_average(power: int) -> dict[str, Column]:
    p = F.pow(F.col("p"), F.lit(float(power))) if power > 1 else F.col("p")
    return {variant(inverse=False): F.sum(F.col("k") * p), variant(inverse=True): F.sum(_inv(F.col("k")) * p)}


def mass_entropy() -> dict[str, Column]:
    return {"value": -F.sum(plogp(F.col("p")))}


def _mass_variance(m: DataFrame) -> DataFrame:
    """Spread of k around the angle-averaged entropy."""
    ent = F.sum(-plogp(F.col("p"))).over(Window.partitionBy(*KEYS))
    angles = F.size(F.collect_set("angle").over(Window.partitionBy(*KEYS)))
    m = m.withColumn("et", ent / angles)
    d = (F.col("k") - F.col("et")) * (F.col("k") - F.col("et"))
    return angle_mean(m, {variant(inverse=False): F.sum(F.col("p") * d),
                          variant(inverse=True): F.sum(F.try_divide(F.col("p"), d))})


def _marginal_entropy(p: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEYS, "angle", "i")
    v = Window.partitionBy(*KEYS, "angle", "j")
    q = p.withColumns({"px": F.sum("p").over(w), "py": F.sum("p").over(v)})
    # each cell carries its share p/px of the marginal's entropy term, so one pass yields HX and HY
    return q.groupBy(*KEYS, "angle").agg(
        (-F.sum(plogp(F.col("p")))).alias("hxy"),
        (-F.sum(F.col("p") * F.log2(F.col("px") * F.col("py") + EPS))).alias("hxy1"),
        (-F.sum(F.col("p") * F.log2(F.col("px") + EPS))).alias("hx"),
        (-F.sum(F.col("p") * F.log2(F.col("py") + EPS))).alias("hy"),
    )


def imc1(p: DataFrame) -> DataFrame:
    div = F.greatest("hx", "hy")
    return _marginal_entropy(p).groupBy(*KEYS).agg(
        F.avg(F.when(div == 0, 0.0).otherwise(F.try_divide(F.col("hxy") - F.col("hxy1"), div))).alias("value"))


def imc2(p: DataFrame) -> DataFrame:
    """The entropy of the product of the marginals is the sum of their entropies: no level pairs."""
    gap = F.col("hx") + F.col("hy") - F.col("hxy")
    val = F.sqrt(F.greatest(1.0 - F.exp(-2.0 * gap), F.lit(0.0)))
    return _marginal_entropy(p).groupBy(*KEYS).agg(F.avg(val).alias("value"))


# ---- statistics of the dense matrix --------------------------------------------------------------

def dense_values(p: DataFrame, levels: DataFrame) -> DataFrame:
    """(keys, v, w): distinct cell values of the dense matrix with their counts.

    Empty cells are never materialised: they are one row v = 0 with weight levels^2 * angles - cells.
    """
    hist = p.groupBy(*KEYS, F.col("p").alias("v")).agg(F.count(F.lit(1)).alias("w"))
    # the cells of an angle sum to 1, so all of them to the number of angles
    one = hist.groupBy(*KEYS).agg(F.collect_list(F.struct("v", "w")).alias("cells"), F.sum("w").alias("nnz"),
                                  F.round(F.sum(F.col("v") * F.col("w"))).cast("long").alias("na"))
    one = one.join(levels.select("case_id", "bin_count", "ng_present"), ["case_id", "bin_count"])
    empty = "ng_present * ng_present * na - nnz"
    cells = f"concat(cells, if({empty} > 0, array(struct(0.0D AS v, {empty} AS w)), array()))"
    return one.select(*KEYS, F.expr(f"explode({cells})").alias("t")).select(*KEYS, "t.v", "t.w")


# per-angle sums over one table: the columns of several features can share an aggregate
CELL = {"Contrast": contrast, "Average": average, "Autocorrelation": autocorrelation, "Dmn": dmn,
        **{g: (lambda g=g: gaussian(g)) for g in GAUSSIANS}}
CLUSTER = {"Cluster": cluster}
DIFFERENCE = {"Homogeneity1": homogeneity1, "Homogeneity2": homogeneity2, "Dissimilarity": dissimilarity,
              "DifferenceAverage": lambda: mass_average(1), "DifferenceEnergy": lambda: mass_average(2),
              "DifferenceEntropy": mass_entropy}
SUM = {"SumAverage": lambda: mass_average(1), "SumEnergy": lambda: mass_average(2), "SumEntropy": mass_entropy}
WHOLE = {"Variance": variance, "Correlation": correlation,
         "DifferenceVariance": lambda pv: _mass_variance(difference_mass(pv)),
         "SumVariance": lambda pv: _mass_variance(sum_mass(pv)), "Imc1": imc1, "Imc2": imc2}
FORMULAS = (*CELL, *CLUSTER, *DIFFERENCE, *SUM, *WHOLE)
_SUFFIXED, _TWO_WAYS = tuple(variant(suffix=s) for s in SUFFIXES), tuple(variant(inverse=w) for w in (False, True))
WHOLE_VARIANTS = {"Variance": _SUFFIXED, "Correlation": _SUFFIXED, "DifferenceVariance": _TWO_WAYS, "SumVariance": _TWO_WAYS,
                  "Imc1": ("value",), "Imc2": ("value",)}
BATCH = 60  # expressions per aggregate, clear of the code generator's method limit


def variants(names=FORMULAS) -> list[tuple[str, str]]:
    """(feature, variant) of every column of the named features, whatever the data hold."""
    built = {**CELL, **CLUSTER, **DIFFERENCE, **SUM}
    return [(n, v) for n in names for v in (WHOLE_VARIANTS[n] if n in WHOLE else built[n]())]


def _groups(pv: DataFrame, levels: DataFrame | None, names):
    """(builders, table) for each shared table that the names need."""
    pick = lambda reg: {n: f for n, f in reg.items() if n in names}
    cell, clus, diff, add = pick(CELL), pick(CLUSTER), pick(DIFFERENCE), pick(SUM)
    ranked = with_levels(pv, levels) if levels is not None else None
    if cell:
        yield cell, ranked if set(cell) - {"Contrast", "Average", "Autocorrelation"} else pv
    if clus:
        yield clus, with_cluster(ranked)
    if diff:
        yield diff, difference_mass(pv)
    if add:
        yield add, sum_mass(pv)


def in_one_pass(names) -> bool:
    """Whether all named features are taken by one aggregate that reads the cell table once."""
    if set(names) & {*CLUSTER, *WHOLE}:
        return len(names) == 1 and not set(names) & set(CLUSTER)
    return any(set(names) <= set(g) and len(variants(names)) <= BATCH for g in (CELL, DIFFERENCE, SUM))


def _unpivoted(w: DataFrame) -> DataFrame:
    """Columns feature|variant to rows."""
    cells = ", ".join("struct('{}' AS feature, '{}' AS variant, `{}` AS value)".format(*c.split("|"), c) for c in w.columns if c not in KEYS)
    return w.select(*KEYS, F.expr(f"explode(array({cells}))").alias("t")).select(*KEYS, "t.*")


def features(p: DataFrame, levels: DataFrame, names=FORMULAS) -> DataFrame:
    """Long (keys, feature, variant, value) of the named features over a normalised cell table.

    Each batch of columns is a job of its own and staged: one plan of all would hold the tables below a dozen times.
    """
    pv, out = with_variants(p), []
    for builders, table in _groups(pv, levels, names):
        items = [(f"{n}|{v}", c) for n, f in builders.items() for v, c in f().items()]
        for at in range(0, len(items), BATCH):
            out.append(stage(_unpivoted(angle_mean(table, dict(items[at:at + BATCH]))), "glcm-batch"))
    for n, fn in WHOLE.items():
        if n in names:
            w = fn(pv)
            out.append(stage(_unpivoted(w.withColumnsRenamed({c: f"{n}|{c}" for c in w.columns if c not in KEYS})), "glcm-batch"))
    return reduce(DataFrame.unionByName, out)


def feature(name: str, cells: DataFrame, bin_counts=(8,), distances=(1,), force2d: int | None = None) -> DataFrame:
    """One co-occurrence feature, a column per variant, per case, bin count and distance."""
    cases = texture.measure_cases(cells, distances, force2d)
    p = texture.normalise(texture.glcm_counts(cells, bin_counts, distances, force2d=force2d, totals=True, cases=cases))
    pv = with_variants(p)
    if name in WHOLE:
        return WHOLE[name](pv)
    plain = name in ("Contrast", "Average", "Autocorrelation") or name in DIFFERENCE or name in SUM
    levels = None if plain else texture.glcm_levels(cells, bin_counts, cases).hint("shuffle_hash")
    (builders, table), = _groups(pv, levels, [name])
    return angle_mean(table, builders[name]())


def dense(cells: DataFrame, bin_counts=(8,), distances=(1,)) -> DataFrame:
    cases = texture.measure_cases(cells, distances)
    p = texture.normalise(texture.glcm_counts(cells, bin_counts, distances, totals=True, cases=cases))
    return dense_values(p, texture.glcm_levels(cells, bin_counts, cases).hint("shuffle_hash"))
