"""Order statistics and moments over (keys, v, w): distinct values with counts.

Works for first-order statistics of a region (a case may hold a third of all cells) and for the
statistics of dense matrices. Values are ranked without a per-case sort (see ``ordering``): each
distinct value gets its rank interval [c0, c1), and everything after that is a plain aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.numeric import EPS, over
from voxelframe.operators import ordering
from voxelframe.session import stage


def collapse(df: DataFrame, keys, value: str = "v") -> DataFrame:
    ok = F.col(value).isNotNull() & ~F.isnan(value)
    for k in keys:  # stated here so that every branch over the result shares one exchange
        ok = ok & F.col(k).isNotNull()
    return df.where(ok).groupBy(*keys, F.col(value).alias("v")).agg(
        F.count(F.lit(1)).alias("w"))


def ranked(vw: DataFrame, keys, spread: bool = False, bound: int | None = None) -> DataFrame:
    """(keys, v, w, n, c0, c1): the rank interval [c0, c1) of each distinct value, the key's total n."""
    r = ordering.running(vw, keys, "v", ["w"], spread=spread, bound=bound)
    return r.select(*keys, "v", "w", F.col("tot_w").alias("n"), (F.col("run_w") - F.col("w")).alias("c0"),
                    F.col("run_w").alias("c1"))


def at_rank(r: str) -> str:
    """Aggregate, as text: the value whose rank interval holds r."""
    return f"max(if(c0 <= {r} AND {r} < c1, v, null))"


def quantile(q: float) -> Column:
    """Aggregate over ranked rows: the linearly interpolated quantile."""
    h = f"((n - 1) * {q}D)"
    a, b = at_rank(f"floor({h})"), at_rank(f"least(floor({h}) + 1, n - 1)")
    return F.expr(f"{a} + ({b} - {a}) * max({h} - floor({h}))")


def percentile(q: float) -> Column:
    """The same for keys known to hold few distinct values (one matrix): the built-in aggregate."""
    return F.percentile(F.col("v"), F.lit(q), F.col("w"))


def trimmed_mean(percent: float) -> Column:
    """Mean after cutting int(percent * n) values from each end."""
    cut = F.floor(F.col("n") * F.lit(percent))
    kept = F.greatest(F.least(F.col("c1"), F.col("n") - cut) - F.greatest(F.col("c0"), cut), F.lit(0))
    return F.sum(kept * F.col("v")) / F.sum(kept)


def _sum(x: Column) -> Column:
    return F.sum(F.col("w") * x)


def _n() -> Column:
    return F.sum("w")


def simple(name: str) -> Column | None:
    """Statistics that need one pass over (v, w)."""
    v = F.col("v")
    guarded = F.when(v == 0, 1.0).otherwise(v)
    log_abs = F.log2(F.abs(guarded))
    table = {
        "Mean": lambda: _sum(v) / _n(),
        "GeoMean1": lambda: F.exp(_sum(log_abs) / _n()),
        "GeoMean2": lambda: F.exp(_sum(F.abs(log_abs)) / _n()),
        "HarmonicMean": lambda: over(_n(), _sum(1.0 / guarded)),
        "Minimum": lambda: F.min(v),
        "Maximum": lambda: F.max(v),
        "Range": lambda: F.abs(F.max(v) - F.min(v)),
        "Energy": lambda: _sum(v * v),
        "L2Norm": lambda: F.sqrt(_sum(v * v)),
        "RootMeanSquared": lambda: F.sqrt(_sum(v * v) / _n()),
        "Mode": lambda: F.max_by(v, F.struct(F.col("w"), -v)),
    }
    return table[name]() if name in table else None


SIMPLE = ("Mean", "GeoMean1", "GeoMean2", "HarmonicMean", "Minimum", "Maximum", "Range", "Energy", "L2Norm",
          "RootMeanSquared", "Mode")


def ordered(name: str, percent=None, quantile=quantile) -> Column | None:
    """Statistics read from the ranks, or through another quantile aggregate."""
    iqr = lambda: F.abs(quantile(0.75) - quantile(0.25))
    table = {
        "Median": lambda: quantile(0.5),
        "25Percentile": lambda: quantile(0.25),
        "75Percentile": lambda: quantile(0.75),
        "InterquartileRange": iqr,
        "LowerNotch": lambda: quantile(0.25) - iqr() * 1.5,
        "UpperNotch": lambda: quantile(0.75) + iqr() * 1.5,
        "TrimMean": lambda: (quantile(0.25) + quantile(0.75) + quantile(0.5) * 2.0) / 4.0,
        "TrimmedMean": lambda: trimmed_mean(percent),
        "Deciles": lambda: quantile(percent / 100.0),
    }
    return table[name]() if name in table else None


ORDERED = ("Median", "25Percentile", "75Percentile", "InterquartileRange", "LowerNotch", "UpperNotch", "TrimMean")

# distance to a centre, then a statistic of the distances
DEVIATIONS = {
    "MeanAbsoluteDeviationMean": ("mean", "avg"),
    "MeanAbsoluteDeviationMedian": ("median", "avg"),
    "MedianAbsoluteDeviationFromMean": ("mean", "median"),
    "MedianAbsoluteDeviationFromMedian": ("median", "median"),
    "MaxAbsoluteDeviationFromMean": ("mean", "max"),
    "MaxAbsoluteDeviationFromMedian": ("median", "max"),
    "MedianAbsoluteDeviation": ("median", "scaled"),
}


def centre(vw: DataFrame, keys, kind: str, small: bool = False) -> DataFrame:
    keys = list(keys)
    if kind == "mean":
        return vw.groupBy(*keys).agg((_sum(F.col("v")) / _n()).alias("mid"))
    if small:
        return vw.groupBy(*keys).agg(percentile(0.5).alias("mid"))
    return ranked(vw, keys).groupBy(*keys).agg(quantile(0.5).alias("mid"))


def deviations(vw: DataFrame, keys, kind: str, small: bool = False) -> DataFrame:
    keys = list(keys)
    d = vw.join(centre(vw, keys, kind, small), keys).withColumn("d", F.abs(F.col("v") - F.col("mid")))
    # placed by value, not by key: the join above may have gathered a key in one task
    return d.select(*keys, F.col("d").alias("v"), "w").repartition(*keys, "v").groupBy(*keys, "v").agg(F.sum("w").alias("w"))


def central_moments(vw: DataFrame, keys) -> DataFrame:
    """n and the mean of the 2nd to 4th power of the distance to the mean."""
    keys = list(keys)
    d = vw.join(centre(vw, keys, "mean"), keys).withColumn("d", F.col("v") - F.col("mid"))
    x = F.col("d")
    return d.groupBy(*keys).agg(_n().alias("n"), (_sum(x * x) / _n()).alias("m2"),
                                (_sum(x * x * x) / _n()).alias("m3"), (_sum(x * x * x * x) / _n()).alias("m4"))


MOMENTS = {
    "Variance": lambda: F.col("m2"),
    "StandardDeviation": lambda: F.sqrt("m2"),
    "Skewness": lambda: F.when(F.col("m2") == 0, 0.0).otherwise(
        F.try_divide(F.col("m3"), F.pow(F.col("m2"), F.lit(1.5)))),
    "Kurtosis": lambda: F.when(F.col("m2") == 0, 0.0).otherwise(F.try_divide(F.col("m4"), F.col("m2") * F.col("m2"))),
}


def _probabilities(vw: DataFrame, keys) -> DataFrame:
    tot = vw.groupBy(*keys).agg(_n().alias("n"))
    return vw.join(tot, list(keys)).withColumn("q", F.col("w") / F.col("n"))


def statistic(vw: DataFrame, keys, name: str, percent=None, small: bool = False) -> DataFrame:
    """(keys, value): one named statistic of the weighted values.

    ``small`` says that every key holds a bounded number of distinct values (a texture matrix), so
    the built-in percentile aggregate may hold them; regions of any size go through the ranks.
    """
    keys = list(keys)
    one = simple(name)
    if one is not None:
        return vw.groupBy(*keys).agg(one.alias("value"))
    if name in DEVIATIONS:
        mid, how = DEVIATIONS[name]
        d = deviations(vw, keys, mid, small)
        if how == "avg":
            return d.groupBy(*keys).agg((_sum(F.col("v")) / _n()).alias("value"))
        if how == "max":
            return d.groupBy(*keys).agg(F.max("v").alias("value"))
        scale = 1.4826 if how == "scaled" else 1.0
        if small:
            return d.groupBy(*keys).agg((percentile(0.5) * scale).alias("value"))
        return ranked(d, keys).groupBy(*keys).agg((quantile(0.5) * scale).alias("value"))
    if name in MOMENTS:
        return central_moments(vw, keys).select(*keys, MOMENTS[name]().alias("value"))
    if name == "Uniformity":
        return _probabilities(vw, keys).groupBy(*keys).agg(F.sum(F.col("q") * F.col("q")).alias("value"))
    if name == "Entropy":
        return _probabilities(vw, keys).groupBy(*keys).agg(
            (-F.sum(F.col("q") * F.log2(F.col("q") + EPS))).alias("value"))
    if name == "GeoMean3":
        low = vw.groupBy(*keys).agg(F.min("v").alias("lo"))
        shift = F.when(F.col("lo") <= 0, F.abs("lo") + 1.0).otherwise(0.0)
        return vw.join(low, keys).groupBy(*keys).agg(
            F.exp(_sum(F.log(F.col("v") + shift)) / _n()).alias("value"))
    if name == "RobustMeanAbsoluteDeviation":
        rv = ranked(vw, keys)
        cut = rv.groupBy(*keys).agg(quantile(0.1).alias("a"), quantile(0.9).alias("b"))
        kept = vw.join(cut, keys).where(F.col("v").between(F.col("a"), F.col("b"))).select(*keys, "v", "w")
        d = deviations(kept, keys, "mean")
        return d.groupBy(*keys).agg((_sum(F.col("v")) / _n()).alias("value"))
    if small and name != "TrimmedMean":
        return vw.groupBy(*keys).agg(ordered(name, percent, percentile).alias("value"))
    return ranked(vw, keys, spread=small).groupBy(*keys).agg(ordered(name, percent).alias("value"))


def block(vw: DataFrame, keys, trims=(0.025, 0.05, 0.1, 0.25), deciles=tuple(range(10, 100, 10)),
          with_variance: bool = True) -> DataFrame:
    """All statistics as one wide row per key: three rankings and a few aggregates in total.

    Steps are staged: each ranking reads its input many times, so a plan of all three would hold the first hundreds of times.
    """
    keys = list(keys)
    vw = stage(vw, "values")
    bound = ordering.largest_group(vw, keys)  # deviations have no more distinct values than the values
    r = stage(ranked(vw, keys, bound=bound), "ranks")
    base = r.groupBy(*keys).agg(
        *[simple(n).alias(n) for n in SIMPLE], *[ordered(n).alias(n) for n in ORDERED],
        *[trimmed_mean(t).alias(f"TrimmedMean_p_{t}") for t in trims],
        *[quantile(d / 100.0).alias(f"Deciles_p_{d}") for d in deciles],
        quantile(0.1).alias("_a"), quantile(0.9).alias("_b"), F.max("n").alias("_n"))
    base = stage(base, "ranked-statistics")
    e = vw.join(base.select(*keys, "Mean", "Median", "Minimum", "_a", "_b", "_n"), keys)
    v, q = F.col("v"), F.col("w") / F.col("_n")
    d1, d2 = v - F.col("Mean"), F.abs(v - F.col("Median"))
    shift = F.when(F.col("Minimum") <= 0, F.abs("Minimum") + 1.0).otherwise(0.0)
    inside = v.between(F.col("_a"), F.col("_b"))
    two = e.groupBy(*keys).agg(
        (_sum(F.abs(d1)) / _n()).alias("MeanAbsoluteDeviationMean"),
        (_sum(d2) / _n()).alias("MeanAbsoluteDeviationMedian"),
        F.max(F.abs(d1)).alias("MaxAbsoluteDeviationFromMean"),
        F.max(d2).alias("MaxAbsoluteDeviationFromMedian"),
        F.exp(_sum(F.log(v + shift)) / _n()).alias("GeoMean3"),
        F.sum(q * q).alias("Uniformity"), (-F.sum(q * F.log2(q + EPS))).alias("Entropy"),
        (_sum(d1 * d1) / _n()).alias("m2"), (_sum(d1 * d1 * d1) / _n()).alias("m3"),
        (_sum(d1 * d1 * d1 * d1) / _n()).alias("m4"),
        (F.sum(F.when(inside, F.col("w") * v)) / F.sum(F.when(inside, F.col("w")))).alias("_mid"))
    names = [n for n in MOMENTS if with_variance or n != "Variance"]
    two = stage(two.select("*", *[MOMENTS[n]().alias(n) for n in names]).drop("m2", "m3", "m4"), "moments")
    rob = e.where(inside).join(two.select(*keys, "_mid"), keys).groupBy(*keys).agg(
        (_sum(F.abs(v - F.col("_mid"))) / _n()).alias("RobustMeanAbsoluteDeviation"))
    out = base.join(two, keys).join(rob, keys, "left")  # two different values have none between the deciles
    for kind, name in (("Mean", "MedianAbsoluteDeviationFromMean"), ("Median", "MedianAbsoluteDeviationFromMedian")):
        d = stage(e.select(*keys, F.abs(v - F.col(kind)).alias("v"), "w").repartition(*keys, "v").groupBy(*keys, "v").agg(
            F.sum("w").alias("w")), "deviations")
        out = out.join(stage(ranked(d, keys, bound=bound).groupBy(*keys).agg(quantile(0.5).alias(name)), "median-deviation"), keys)
    out = out.withColumn("MedianAbsoluteDeviation", F.col("MedianAbsoluteDeviationFromMedian") * 1.4826)
    return out.drop("_a", "_b", "_n", "_mid")


def to_long(df: DataFrame, keys, prefix: str = "") -> DataFrame:
    cells = ", ".join(f"struct('{prefix}{n}' AS feature, cast(`{n}` AS double) AS value)" for n in df.columns if n not in keys)
    return df.select(*keys, F.expr(f"explode(array({cells}))").alias("t")).select(*keys, "t.feature", "t.value")
