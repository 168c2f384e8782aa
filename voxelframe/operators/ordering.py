"""Running totals and ranks over a whole ordered group without sorting it in one task.

A group (class, label, case) may hold a third of all rows. Rows are first summed per distinct order
value. A group with many of them is cut at its approximate quantiles, and a part that still holds many
is cut again at its own, so parts are even whatever the distribution: 4,096 of them at most, each with
about 1/4096 of the group's distinct values once that is more than FILL. The running total is the start
of the part plus a window inside it. Small groups stay in one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64       # per level; two levels
FILL = 2048      # distinct values from which a part is cut


def _cuts(order: str) -> Column:
    return F.percentile_approx(order, [k / PARTS for k in range(1, PARTS)], 10_000)


def _part(order: str, cuts: str) -> Column:
    """How many of the cuts lie below the value; 0 where there are none."""
    return F.coalesce(F.size(F.filter(F.col(cuts), lambda c: c < F.col(order))), F.lit(0))


def running(df: DataFrame, keys, order: str, sums, descending: bool = False, fill: int = FILL, spread: bool = True,
            *, bound: int | None = None) -> DataFrame:
    """(keys, order, sums.., run_<sum>.., tot_<sum>..) with one row per distinct order value.

    ``run_<sum>`` includes the row's own value. ``spread`` places the rows by key and value first: a
    group then lies in many tasks, and the branches below read that one exchange. Leave it out only
    where the input was just aggregated by key and value. ``bound`` is the most distinct values that a group
    is known to have: up to ``fill`` every group is one part, and one window over it does.
    """
    keys = list(keys)
    if bound is not None and bound <= fill:
        return _small(df, keys, order, sums, descending)
    if spread:
        df = df.repartition(*keys, order)
    ok = F.col(order).isNotNull()
    for k in keys:  # stated here so that the branches below share one exchange
        ok = ok & F.col(k).isNotNull()
    g = df.where(ok).groupBy(*keys, order).agg(*[F.sum(c).alias(c) for c in sums])
    rng = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"tot_{c}") for c in sums])
    g = g.join(rng, keys)
    first = g.where(F.col("_n") > fill).groupBy(*keys).agg(_cuts(order).alias("_cuts"))  # large groups only
    g = g.join(first, keys, "left").withColumn("_b", _part(order, "_cuts")).drop("_cuts")
    second = g.where(F.col("_n") > fill).groupBy(*keys, "_b").agg(_cuts(order).alias("_cuts"), F.count(F.lit(1)).alias("_m")) \
        .where(F.col("_m") > fill).drop("_m")
    g = g.join(second, [*keys, "_b"], "left").withColumn("_c", _part(order, "_cuts")).drop("_cuts", "_n")
    o = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())

    def starts(t: DataFrame, part, by: str, tag: str) -> DataFrame:
        """Totals of the parts before each one; a partition has at most PARTS rows."""
        w = Window.partitionBy(*part).orderBy(o(by)).rowsBetween(Window.unboundedPreceding, -1)
        return t.select(*part, by, *[F.coalesce(F.sum(f"_s_{c}").over(w), F.lit(0)).alias(f"{tag}{c}") for c in sums])

    inner = g.groupBy(*keys, "_b", "_c").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    outer = inner.groupBy(*keys, "_b").agg(*[F.sum(f"_s_{c}").alias(f"_s_{c}") for c in sums])
    start = starts(inner, [*keys, "_b"], "_c", "_i_").join(starts(outer, keys, "_b", "_o_"), [*keys, "_b"])
    i = Window.partitionBy(*keys, "_b", "_c").orderBy(o(order)).rowsBetween(Window.unboundedPreceding, 0)
    g = g.select("*", *[F.sum(c).over(i).alias(f"_r_{c}") for c in sums]).join(start, [*keys, "_b", "_c"])
    return g.select(*keys, order, *sums, *[(F.col(f"_r_{c}") + F.col(f"_i_{c}") + F.col(f"_o_{c}")).alias(f"run_{c}") for c in sums],
                    *[f"tot_{c}" for c in sums])


def _small(df: DataFrame, keys, order: str, sums, descending: bool) -> DataFrame:
    ok = F.col(order).isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    g = df.where(ok).groupBy(*keys, order).agg(*[F.sum(c).alias(c) for c in sums])
    o = F.col(order).desc() if descending else F.col(order).asc()
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    return g.select(*keys, order, *sums, *[F.sum(c).over(upto).alias(f"run_{c}") for c in sums], *[F.sum(c).over(whole).alias(f"tot_{c}") for c in sums])


def largest_group(df: DataFrame, keys) -> int:
    """Rows of the largest group of a staged table: one number."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def row_rank(df: DataFrame, keys, order: str) -> DataFrame:
    """Rows with ``rank`` (0-based) by a unique order column within keys, and the group size ``size``."""
    keys = list(keys)
    r = running(df.select(*keys, order, F.lit(1).alias("one")), keys, order, ["one"])
    r = r.select(*keys, order, (F.col("run_one") - 1).alias("rank"), F.col("tot_one").alias("size"))
    return df.join(r, [*keys, order])


def contiguous_part(rank: Column, size: Column, parts: int) -> Column:
    """Part number of k contiguous parts, the first size % k of them one longer."""
    q, r = F.floor(size / parts), size % parts
    edge = r * (q + 1)
    return F.when(rank < edge, F.floor(rank / (q + 1))).otherwise(
        r + F.floor(F.try_divide(rank - edge, q))).cast("int")


def stratified_folds(df: DataFrame, label: str, row_id: str, folds: int) -> DataFrame:
    return row_rank(df, [label], row_id).withColumn(
        "fold", contiguous_part(F.col("rank"), F.col("size"), folds)).drop("rank", "size")
