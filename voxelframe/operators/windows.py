"""Feature maps: the features of the neighbourhood of every region cell, of any radius.

A neighbourhood is a cube, so it is gathered one axis at a time by window frames along the lines of that axis: a cell stays
one row whatever the radius. Sums, minima and maxima (the moments) combine as they are; for order statistics the frames
gather the values themselves into an array a row. Pairs of neighbours are placed at the corner of the box they span: both
cells lie in a cube of radius r if that corner is within a frame shortened by the box's length, so pairs are gathered alike.
Lines are never longer than an axis of the volume. Positions of the region's box outside the region hold nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.numeric import EPS, over
from voxelframe.operators import cooccurrence as co
from voxelframe.operators import grid, texture, weighted

AXES = ("z", "y", "x")
PLACE = ["case_id", *AXES]
MOMENT_NAMES = ("Mean", "GeoMean1", "GeoMean2", "HarmonicMean", "Minimum", "Maximum", "Range", "Energy", "L2Norm", "RootMeanSquared",
                "Variance", "StandardDeviation", "Skewness", "Kurtosis")
ORDER_NAMES = ("Median", "Mode", "25Percentile", "75Percentile", "InterquartileRange", "LowerNotch", "UpperNotch", "TrimMean", "GeoMean3",
               *weighted.DEVIATIONS, "RobustMeanAbsoluteDeviation", "Uniformity", "Entropy",
               *[f"TrimmedMean_p_{p}" for p in co.TRIMS], *[f"Deciles_p_{d}" for d in co.DECILES])


def box_positions(cells: DataFrame) -> DataFrame:
    """(case_id, z, y, x): every position of the boxes of the regions."""
    box = grid.bounding_box(cells)
    for a in AXES:
        box = box.withColumn(a, F.explode(F.sequence(f"{a}0", f"{a}1")))
    return box.select(*PLACE)


def frames(df: DataFrame, axis: str, keys, low: int, high: int):
    """The window along an axis from `low` to `high` steps away."""
    return Window.partitionBy(*keys, *[a for a in AXES if a != axis]).orderBy(axis).rangeBetween(low, high)


# ---- moments ------------------------------------------------------------------------------------

def moments(cells: DataFrame, radius: int, names=MOMENT_NAMES) -> DataFrame:
    """(case_id, z, y, x, names..) of every region cell, by sums along one axis after the other.

    Powers are taken of the distance to the mean of the case, so that little cancels.
    """
    centre = cells.groupBy("case_id").agg(F.avg("v").alias("mid"))
    d = F.col("v") - F.col("mid")
    guarded = F.when(F.col("v") == 0, 1.0).otherwise(F.col("v"))
    lg = F.log2(F.abs(guarded))
    own = cells.select(*PLACE, "v").join(centre, "case_id").select(
        *PLACE, F.lit(1).cast("long").alias("n"), d.alias("d1"), (d * d).alias("d2"), (d * d * d).alias("d3"), (d * d * d * d).alias("d4"),
        (F.col("v") * F.col("v")).alias("sq"), lg.alias("lg"), F.abs(lg).alias("la"), (1.0 / guarded).alias("rc"),
        F.col("v").alias("lo"), F.col("v").alias("hi"), F.lit(True).alias("here"))
    t = box_positions(cells).join(own, PLACE, "left")
    combine = {**{c: F.sum for c in ("n", "d1", "d2", "d3", "d4", "sq", "lg", "la", "rc")}, "lo": F.min, "hi": F.max}
    for a in AXES[::-1]:
        w = frames(t, a, ["case_id"], -radius, radius)
        t = t.withColumns({c: f(c).over(w) for c, f in combine.items()})
    t = t.where("here").join(centre, "case_id")
    n = F.col("n").cast("double")
    m1, r2, r3, r4 = (F.col(f"d{k}") / n for k in (1, 2, 3, 4))
    m2 = F.when(F.col("lo") == F.col("hi"), 0.0).otherwise(F.greatest(r2 - m1 * m1, F.lit(0.0)))
    m3 = r3 - 3 * m1 * r2 + 2 * m1 * m1 * m1
    m4 = r4 - 4 * m1 * r3 + 6 * m1 * m1 * r2 - 3 * m1 * m1 * m1 * m1
    made = {"Mean": F.col("mid") + m1, "GeoMean1": F.exp(F.col("lg") / n), "GeoMean2": F.exp(F.col("la") / n), "HarmonicMean": over(n, F.col("rc")),
            "Minimum": F.col("lo"), "Maximum": F.col("hi"), "Range": F.abs(F.col("hi") - F.col("lo")), "Energy": F.col("sq"), "L2Norm": F.sqrt("sq"),
            "RootMeanSquared": F.sqrt(F.col("sq") / n), "Variance": m2, "StandardDeviation": F.sqrt(m2),
            "Skewness": F.when(m2 == 0, 0.0).otherwise(F.try_divide(m3, F.pow(m2, F.lit(1.5)))),
            "Kurtosis": F.when(m2 == 0, 0.0).otherwise(F.try_divide(m4, m2 * m2))}
    return t.select(*PLACE, *[made[k].alias(k) for k in names])


# ---- order statistics -----------------------------------------------------------------------------

def gathered(cells: DataFrame, radius: int, value: str = "v") -> DataFrame:
    """(case_id, z, y, x, a): the values in the neighbourhood of every region cell, sorted."""
    t = box_positions(cells).join(cells.select(*PLACE, F.array(value).alias("a"), F.lit(True).alias("here")), PLACE, "left")
    for a in AXES[::-1]:
        t = t.withColumn("a", F.flatten(F.collect_list("a").over(frames(t, a, ["case_id"], -radius, radius))))
    return t.where("here").select(*PLACE, F.array_sort("a").alias("a"))


def _total(a, of=lambda v: v) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + of(v))


def _mean(a, of=lambda v: v) -> Column:
    """Null for an empty array: two different values have none between their first and last decile."""
    return F.try_divide(_total(a, of), F.size(a))


def _quantile(a, q: float) -> Column:
    """Linearly interpolated, of a sorted array."""
    h = (F.size(a) - 1) * F.lit(q)
    low = F.floor(h).cast("int")
    one = F.get(a, low)
    return one + (F.get(a, F.least(low + 1, F.size(a) - 1)) - one) * (h - low)


def order_statistics(rows: DataFrame, names=ORDER_NAMES) -> DataFrame:
    """(case_id, z, y, x, names..) from rows with a sorted array `a`."""
    a = F.col("a")
    t = rows.withColumns({"mu": _mean(a), "q1": _quantile(a, 0.25), "q2": _quantile(a, 0.5), "q3": _quantile(a, 0.75), "n": F.size(a)})
    away = lambda mid: F.array_sort(F.transform(a, lambda v: F.abs(v - F.col(mid))))
    counts = F.transform(F.array_distinct(a), lambda v: F.struct(
        F.size(F.filter(a, lambda w: w == v)).alias("w"), (-v).alias("v")))
    low, high = _quantile(a, 0.1), _quantile(a, 0.9)
    t = t.withColumns({"from_mean": away("mu"), "from_median": away("q2"), "counts": counts, "p10": low, "p90": high})
    t = t.withColumn("inner", F.filter(a, lambda v: (v >= F.col("p10")) & (v <= F.col("p90")))).withColumn("inner_mu", _mean(F.col("inner")))
    share = lambda c: c["w"] / F.col("n")
    iqr = F.abs(F.col("q3") - F.col("q1"))
    shift = F.when(a[0] <= 0, F.abs(a[0]) + 1.0).otherwise(0.0)
    cut = lambda p: F.floor(F.col("n") * F.lit(p)).cast("int")
    made = {"Median": F.col("q2"), "Mode": -F.array_max("counts")["v"], "25Percentile": F.col("q1"), "75Percentile": F.col("q3"),
            "InterquartileRange": iqr, "LowerNotch": F.col("q1") - iqr * 1.5, "UpperNotch": F.col("q3") + iqr * 1.5,
            "TrimMean": (F.col("q1") + F.col("q3") + F.col("q2") * 2.0) / 4.0, "GeoMean3": F.exp(_total(a, lambda v: F.log(v + shift)) / F.col("n")),
            "MeanAbsoluteDeviationMean": _mean(F.col("from_mean")), "MeanAbsoluteDeviationMedian": _mean(F.col("from_median")),
            "MedianAbsoluteDeviationFromMean": _quantile(F.col("from_mean"), 0.5), "MedianAbsoluteDeviationFromMedian": _quantile(F.col("from_median"), 0.5),
            "MaxAbsoluteDeviationFromMean": F.array_max("from_mean"), "MaxAbsoluteDeviationFromMedian": F.array_max("from_median"),
            "MedianAbsoluteDeviation": _quantile(F.col("from_median"), 0.5) * 1.4826,
            "RobustMeanAbsoluteDeviation": _mean(F.col("inner"), lambda v: F.abs(v - F.col("inner_mu"))),
            "Uniformity": _total(F.col("counts"), lambda c: share(c) * share(c)),
            "Entropy": -_total(F.col("counts"), lambda c: share(c) * F.log2(share(c) + EPS)),
            **{f"TrimmedMean_p_{p}": _mean(F.slice(a, cut(p) + 1, F.col("n") - 2 * cut(p))) for p in co.TRIMS},
            **{f"Deciles_p_{d}": _quantile(a, d / 100.0) for d in co.DECILES}}
    return t.select(*PLACE, *[made[k].alias(k) for k in names])


# ---- co-occurrence ----------------------------------------------------------------------------------

def pair_counts(levels: DataFrame, radius: int, distances=(1,)) -> DataFrame:
    """(case_id, bin_count, dist, angle, i, j, n): co-occurring levels in the neighbourhood of every region cell, both ways.

    case_id is (case_id, z, y, x) of the centre. `levels` has one bin count. A pair is one row for each angle and stays one on
    all three axes; what the frames gather is counted in the task that holds the centre.
    """
    spark = levels.sparkSession
    offs = [o for o in grid.offsets(distances) if max(map(abs, o[2:])) <= 2 * radius]
    lengths = spark.createDataFrame([(o[0], o[1], *map(abs, o[2:])) for o in offs], "angle int, dist int, lz int, ly int, lx int")
    pairs = grid.neighbour_pairs(levels.select(*PLACE, "g"), offs)
    code = F.array(F.struct(F.col("g").alias("i"), F.col("g2").alias("j")))
    corner = pairs.select("case_id", "angle", "dist", *[F.least(a, f"{a}2").alias(a) for a in AXES], code.alias("c"))
    corner = corner.groupBy(*PLACE, "angle", "dist").agg(F.flatten(F.collect_list("c")).alias("c"))  # two at most share a corner
    t = box_positions(levels).join(F.broadcast(lengths)).join(corner, [*PLACE, "angle", "dist"], "left")  # a fixed table of offsets
    keys = ["case_id", "angle", "dist"]
    for a in AXES[::-1]:
        get = lambda n: F.flatten(F.collect_list("c").over(frames(t, a, keys, -radius, radius - n)))  # noqa: B023,E731
        every = sorted({abs(o[2 + AXES.index(a)]) for o in offs})
        t = t.withColumn("c", reduce(lambda rest, n: F.when(F.col(f"l{a}") == n, get(n)).otherwise(rest), every[1:], get(every[0])))  # noqa: B023
    t = t.join(levels.select(*PLACE, "bin_count"), PLACE)  # centres are region cells
    one = t.select(F.struct(*PLACE).alias("case_id"), "bin_count", "dist", "angle", F.explode("c").alias("c"))
    both = F.array(F.struct("c.i", "c.j"), F.struct(F.col("c.j").alias("i"), F.col("c.i").alias("j")))
    one = one.groupBy(*texture.KEYS, "angle", "c").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.explode(both))
    return one.groupBy(*texture.KEYS, "angle", "t.i", "t.j").agg(F.sum("n").alias("n"))


def level_facts(levels: DataFrame, radius: int) -> DataFrame:
    """The levels present in each neighbourhood and their moments, as texture.glcm_levels gives them for a region."""
    t = gathered(levels, radius, "g").join(levels.select(*PLACE, "bin_count"), PLACE)
    t = t.select(F.struct(*PLACE).alias("case_id"), "bin_count", F.array_distinct("a").alias("levels")).withColumns(
        {"ng_present": F.size("levels").cast("long"), "ng": F.array_max("levels"), "lv_avg": _mean(F.col("levels"))})
    spread = _total(F.col("levels"), lambda v: (v - F.col("lv_avg")) * (v - F.col("lv_avg")))
    return t.withColumn("lv_sd", F.sqrt(F.try_divide(spread, (F.col("ng_present") - 1).cast("double"))))
