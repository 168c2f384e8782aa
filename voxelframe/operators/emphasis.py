"""Features of run-length and dependence matrices, and of the neighbourhood-difference table.

Cells are (keys, [angle,] g, j, n): g the gray level, j the run length or the dependence. Each feature
is one aggregate over the cells, so any subset of them shares one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.numeric import plogp, ratio

RUN_LENGTH = ("ShortRunEmphasis", "LongRunEmphasis", "GrayLevelNonUniformity", "GrayLevelNonUniformityNormalized",
              "RunLengthNonUniformity", "RunLengthNonUniformityNormalized", "RunPercentage", "GrayLevelVariance",
              "RunVariance", "RunEntropy", "LowGrayLevelRunEmphasis", "HighGrayLevelRunEmphasis",
              "ShortRunLowGrayLevelEmphasis", "ShortRunHighGrayLevelEmphasis", "LongRunLowGrayLevelEmphasis",
              "LongRunHighGrayLevelEmphasis")
DEPENDENCE = ("SmallDependenceEmphasis", "LargeDependenceEmphasis", "GrayLevelNonUniformity",
              "DependenceNonUniformity", "DependenceNonUniformityNormalized", "GrayLevelVariance",
              "DependenceVariance", "DependenceEntropy", "LowGrayLevelEmphasis", "HighGrayLevelEmphasis",
              "SmallDependenceLowGrayLevelEmphasis", "SmallDependenceHighGrayLevelEmphasis",
              "LargeDependenceLowGrayLevelEmphasis", "LargeDependenceHighGrayLevelEmphasis")
ZONE = ("SmallAreaEmphasis", "LargeAreaEmphasis", "GrayLevelNonUniformity", "GrayLevelNonUniformityNormalized", "SizeZoneNonUniformity",
        "SizeZoneNonUniformityNormalized", "ZonePercentage", "GrayLevelVariance", "ZoneVariance", "ZoneEntropy", "LowGrayLevelZoneEmphasis",
        "HighGrayLevelZoneEmphasis", "SmallAreaLowGrayLevelEmphasis", "SmallAreaHighGrayLevelEmphasis", "LargeAreaLowGrayLevelEmphasis",
        "LargeAreaHighGrayLevelEmphasis")
NEIGHBOURHOOD = ("Coarseness", "Contrast", "Busyness", "Complexity", "Strength")


def _cell() -> tuple[Column, Column, Column]:
    """Count, level and length of a cell."""
    return F.col("n"), F.col("g").cast("double"), F.col("j").cast("double")


def _total() -> Column:
    return F.sum("n").cast("double")


def _emphasis(weight: Column) -> Column:
    return F.sum(F.col("n") * weight) / _total()


def _variance(x: Column) -> Column:
    n = F.col("n")
    mu = F.sum(n * x) / _total()
    return F.sum(n * x * x) / _total() - mu * mu


def _entropy() -> Column:
    return -F.sum(plogp(F.col("p")))


def _non_uniformity(mass: str, power: int) -> Column:
    """Sum of squared marginals: each cell carries its marginal, so sum n * marginal."""
    t = _total()
    out = F.sum(F.col("n") * F.col(mass)).cast("double")
    for _ in range(power):
        out = out / t
    return out


def _table(short: str, long: str, entropy: str, low: str, high: str) -> dict[str, Column]:
    _, i, j = _cell()
    return {
        f"{short}Emphasis": _emphasis(1.0 / (j * j)),
        f"{long}Emphasis": _emphasis(j * j),
        low: _emphasis(1.0 / (i * i)),
        high: _emphasis(i * i),
        f"{short}LowGrayLevelEmphasis": _emphasis(1.0 / (i * i * j * j)),
        f"{short}HighGrayLevelEmphasis": _emphasis(i * i / (j * j)),
        f"{long}LowGrayLevelEmphasis": _emphasis(j * j / (i * i)),
        f"{long}HighGrayLevelEmphasis": _emphasis(i * i * j * j),
        "GrayLevelVariance": _variance(i),
        "GrayLevelNonUniformity": _non_uniformity("mass_g", 1),
        entropy: _entropy(),
    }


def run_length() -> dict[str, Column]:
    t = _table("ShortRun", "LongRun", "RunEntropy", "LowGrayLevelRunEmphasis", "HighGrayLevelRunEmphasis")
    n, _, j = _cell()
    t["GrayLevelNonUniformityNormalized"] = _non_uniformity("mass_g", 2)
    t["RunLengthNonUniformity"] = _non_uniformity("mass_j", 1)
    t["RunLengthNonUniformityNormalized"] = _non_uniformity("mass_j", 2)
    t["RunPercentage"] = _total() / F.sum(n * j)
    t["RunVariance"] = _variance(j)
    return t


def zone() -> dict[str, Column]:
    """j is the number of cells of a zone of one level."""
    t = _table("SmallArea", "LargeArea", "ZoneEntropy", "LowGrayLevelZoneEmphasis", "HighGrayLevelZoneEmphasis")
    n, _, j = _cell()
    t["GrayLevelNonUniformityNormalized"] = _non_uniformity("mass_g", 2)
    t["SizeZoneNonUniformity"] = _non_uniformity("mass_j", 1)
    t["SizeZoneNonUniformityNormalized"] = _non_uniformity("mass_j", 2)
    t["ZonePercentage"] = _total() / F.sum(n * j)
    t["ZoneVariance"] = _variance(j)
    return t


def dependence() -> dict[str, Column]:
    t = _table("SmallDependence", "LargeDependence", "DependenceEntropy", "LowGrayLevelEmphasis",
               "HighGrayLevelEmphasis")
    t["DependenceNonUniformity"] = _non_uniformity("mass_j", 1)
    t["DependenceNonUniformityNormalized"] = _non_uniformity("mass_j", 2)
    t["DependenceVariance"] = _variance(_cell()[2])
    return t


def cell_features(cells: DataFrame, keys, table: dict[str, Column], names=None, angle: bool = False) -> DataFrame:
    """One column per requested feature; with ``angle`` the mean over the angles."""
    keys = list(keys)
    names = list(names or table)
    unit = [*keys, "angle"] if angle else keys
    c = cells.repartition(*keys)  # a matrix has at most levels x lengths x angles rows
    c = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*unit)))
    c = c.withColumn("mass_g", F.sum("n").over(Window.partitionBy(*unit, "g")))
    c = c.withColumn("mass_j", F.sum("n").over(Window.partitionBy(*unit, "j")))
    out = c.groupBy(*unit).agg(*[table[n].alias(n) for n in names])
    if angle:
        out = out.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names])
    return out


# ---- neighbourhood difference --------------------------------------------------------------------

def ngtdm_coefficients(table: DataFrame, keys) -> DataFrame:
    """p_i, s_i with the number of cells (nvp) and of levels present (ngp); at most bin_count rows a key."""
    w = Window.partitionBy(*keys)
    return table.withColumns({
        "nvp": F.sum("n").over(w), "ngp": F.count(F.lit(1)).over(w), "s_all": F.sum("s").over(w),
    }).withColumn("p", F.col("n") / F.col("nvp"))


def _level_pairs(c: DataFrame, keys) -> DataFrame:
    """Ordered pairs of levels of one key: bounded by bin_count squared (4096 at 64 bins)."""
    b = c.select(*keys, F.col("g").alias("g2"), F.col("p").alias("p2"), F.col("s").alias("s2"))
    return c.join(b, list(keys))


def ngtdm_features(table: DataFrame, keys) -> DataFrame:
    keys = list(keys)
    c = ngtdm_coefficients(table.repartition(*keys), keys)
    i, j = F.col("g").cast("double"), F.col("g2").cast("double")
    p, p2, s, s2 = F.col("p"), F.col("p2"), F.col("s"), F.col("s2")
    one = c.groupBy(*keys).agg(F.sum(p * s).alias("ps"), F.max("nvp").alias("nvp"), F.max("ngp").alias("ngp"),
                               F.max("s_all").alias("s_all"))
    two = _level_pairs(c, keys).groupBy(*keys).agg(
        F.sum(p * p2 * (i - j) * (i - j)).alias("c"), F.sum(F.abs(i * p - j * p2)).alias("b"),
        F.sum(F.abs(i - j) * (p * s + p2 * s2) / (p + p2)).alias("x"),
        F.sum((p + p2) * (i - j) * (i - j)).alias("t"))
    ngp = F.col("ngp").cast("double")
    return one.join(two, keys).select(
        *keys,
        F.when(F.col("ps") == 0, 1e6).otherwise(F.try_divide(F.lit(1.0), F.col("ps"))).alias("Coarseness"),
        F.when(ngp <= 1, 0.0).otherwise(
            F.try_divide(F.col("c"), ngp * (ngp - 1.0)) * F.col("s_all") / F.col("nvp")).alias("Contrast"),
        ratio(F.col("ps"), F.col("b")).alias("Busyness"),
        (F.col("x") / F.col("nvp")).alias("Complexity"),
        ratio(F.col("t"), F.col("s_all")).alias("Strength"),
    )
