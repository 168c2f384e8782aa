"""Texture matrices as sparse cell tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.operators import grid
from voxelframe.session import stage

KEYS = ["case_id", "bin_count", "dist"]


LOCAL_CELLS = 1 << 17  # a case of at most so many cells is one task's: what is counted of it does not cross the network
TASK_PAIRS = 1 << 20   # pairs that a task looks for, unless one case has more


@dataclass(frozen=True)
class Cases:
    """Range and number of cells of every case, and how many tasks the cases are dealt to."""

    table: DataFrame
    tasks: int
    largest: int


def measure_cases(cells: DataFrame, distances=(1,), force2d: int | None = None) -> Cases:
    table = stage(cells.groupBy("case_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("cells")), "cases")
    work, largest = table.agg(F.sum(F.least("cells", F.lit(LOCAL_CELLS))), F.max("cells")).first()
    pairs = (work or 0) * len(grid.offsets(distances, force2d=force2d))
    return Cases(table, max(cells.sparkSession.sparkContext.defaultParallelism, -(-pairs // TASK_PAIRS)), largest or 0)


def _levels_by_case(cells: DataFrame, top: int, cases: Cases, columns) -> tuple[DataFrame, DataFrame | None]:
    """The columns and the level ``g`` of each cell: cells of cases that fit a task, placed by case, and those of larger ones."""
    large, small = None, cells
    if cases.largest > LOCAL_CELLS:
        # at most one id in LOCAL_CELLS cells
        ids = F.broadcast(cases.table.where(F.col("cells") > LOCAL_CELLS).select("case_id"))
        large, small = cells.join(ids, "case_id", "left_semi"), cells.join(ids, "case_id", "left_anti")
        large = grid.discretise(large, top)
    facts = cases.table.repartition(cases.tasks, "case_id").hint("shuffle_hash")
    placed = small.select("case_id", *columns, "v").repartition(cases.tasks, "case_id").join(facts, "case_id")
    g = grid.level_of(F.col("v"), F.col("lo"), F.col("hi"), top)
    return placed.select("case_id", *[c for c in placed.columns if c not in ("case_id", "v", "lo", "hi", "cells")], g.alias("g")), large


def _fine_counts(cells: DataFrame, offs, top: int, cases: Cases) -> DataFrame:
    """Counted pairs of the finest levels, placed by case."""
    lev, large = _levels_by_case(cells, top, cases, [grid.cell_key().alias("cell")])
    step = F.array(*[F.struct(F.lit(o[0]).alias("angle"), F.lit(o[1]).alias("dist"), F.lit(grid.key_step(*o[2:])).alias("step")) for o in offs])
    centre = lev.withColumn("o", F.explode(step)).select(
        "case_id", F.col("g").alias("i"), "o.dist", "o.angle", (F.col("cell") + F.col("o.step")).alias("cell"))
    pairs = centre.join(lev.select("case_id", "cell", F.col("g").alias("j")).hint("shuffle_hash"), ["case_id", "cell"])
    fine = pairs.groupBy("case_id", "dist", "angle", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    if large is None:
        return fine
    return fine.unionByName(_pair_counts(large, offs, ["case_id"]).repartition(cases.tasks, "case_id"))


def glcm_counts(cells: DataFrame, bin_counts=(8,), distances=(1,), symmetric: bool = True,
                force2d: int | None = None, totals: bool = False, cases: Cases | None = None) -> DataFrame:
    """(case_id, bin_count, dist, angle, i, j, n): co-occurring levels, both cells in the region.

    Neighbours are matched once on the finest levels; coarser bin counts are rolled up from the
    counted cells when the edges nest (grid.nested), instead of joining once per bin count. Then the
    result is placed by case, and only cells and the counts of large cases have crossed the network.
    ``totals`` adds the pairs of the angle (``total``) if the edges nest.
    """
    if max(distances) > grid.MARGIN:
        raise ValueError(f"offsets reach at most {grid.MARGIN} cells")
    if not grid.nested(bin_counts):
        return glcm_of_levels(grid.discretise_many(cells, bin_counts), distances, symmetric, force2d)
    top = max(bin_counts)
    fine = _fine_counts(cells, grid.offsets(distances, force2d=force2d), top, cases or measure_cases(cells, distances, force2d))
    key = ["case_id", "dist", "angle"]
    if totals:
        fine = fine.withColumn("total", F.sum("n").over(Window.partitionBy(*key)) * (2 if symmetric else 1))
        key.append("total")
    # a symmetric matrix is counted by its upper half, which half as many rows hold
    i, j = (F.least("i", "j"), F.greatest("i", "j")) if symmetric else (F.col("i"), F.col("j"))
    if len(bin_counts) == 1 and not symmetric:
        return fine.withColumn("bin_count", F.lit(top)).select(*KEYS, "angle", "i", "j", "n", *key[3:])
    arr = F.array(*[F.struct(F.lit(b).alias("bin_count"), grid.coarsen(i, top, b).alias("i"), grid.coarsen(j, top, b).alias("j")) for b in bin_counts])
    out = fine.withColumn("t", F.explode(arr)).select(*key, "n", "t.bin_count", "t.i", "t.j")
    out = out.groupBy(*key, "bin_count", "i", "j").agg(F.sum("n").alias("n"))
    if symmetric:
        both = "if(i = j, array(struct(i, j, 2 * n AS n)), array(struct(i, j, n), struct(j AS i, i AS j, n)))"
        out = out.withColumn("t", F.expr(f"explode({both})")).select(*key, "bin_count", "t.i", "t.j", "t.n")
    return out.select(*KEYS, "angle", "i", "j", "n", *key[3:])


def glcm_of_levels(lev: DataFrame, distances=(1,), symmetric: bool = True, force2d: int | None = None) -> DataFrame:
    """The same from cells that already carry ``bin_count`` and ``g``; case_id may be any key, a struct too."""
    out = _pair_counts(lev, grid.offsets(distances, force2d=force2d), ["case_id", "bin_count"])
    if not symmetric:
        return out.select(*KEYS, "angle", "i", "j", "n")
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    out = out.withColumn("t", F.explode(both)).select(*KEYS, "angle", "n", "t.i", "t.j")
    return out.groupBy(*KEYS, "angle", "i", "j").agg(F.sum("n").alias("n"))


def _pair_counts(lev: DataFrame, offs, keys) -> DataFrame:
    """Counted level pairs."""
    pairs = grid.neighbour_pairs(lev.select(*keys, "z", "y", "x", "g"), offs, keys=keys)
    return pairs.groupBy(*keys, "dist", "angle", F.col("g").alias("i"), F.col("g2").alias("j")).agg(F.count(F.lit(1)).alias("n"))


def normalise(counts: DataFrame, keys=tuple(KEYS), by_case: bool = False) -> DataFrame:
    """Add ``p`` = n / total of the angle. Groups here hold at most levels x levels rows.

    Counts that know their total, or are placed ``by_case``, stay where they are.
    """
    if "total" in counts.columns:
        return counts.withColumn("p", F.col("n") / F.col("total")).drop("total")
    w = Window.partitionBy(*keys, "angle")
    placed = counts if by_case else counts.repartition(*keys)  # one exchange that every later per-key aggregate reuses
    return placed.withColumn("p", F.col("n") / F.sum("n").over(w))


def angle_weight(norm: str, dz: Column, dy: Column, dx: Column, spacing=(1.0, 1.0, 1.0),
                 decay: bool = True) -> Column:
    """Weight of an angle from its physical length; co-occurrence uses exp(-d^2), run length d."""
    a = [F.abs(c) * F.lit(float(s)) for c, s in zip((dz, dy, dx), spacing)]
    if norm == "infinity":
        d = F.greatest(*a)
    elif norm == "euclidean":
        d = F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
    elif norm == "manhattan":
        d = a[0] + a[1] + a[2]
    else:
        return F.lit(1.0)
    return F.exp(-d * d) if decay else d


def glcm_weighted(counts: DataFrame, norm: str, distances=(1,), spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Angles collapsed into one matrix by weight, then normalised: angle is 0."""
    spark = counts.sparkSession
    offs = spark.createDataFrame(grid.offsets(distances), "angle int, dist int, dz int, dy int, dx int")
    w = offs.select("angle", "dist", angle_weight(
        norm, F.col("dz"), F.col("dy"), F.col("dx"), spacing).alias("w"))
    out = counts.join(F.broadcast(w), ["dist", "angle"])  # a fixed table of offsets
    out = out.groupBy(*KEYS, "i", "j").agg(F.sum(F.col("n") * F.col("w")).alias("n"))
    return normalise(out.withColumn("angle", F.lit(0)), by_case=True)


def glcm_levels(cells: DataFrame, bin_counts=(8,), cases: Cases | None = None) -> DataFrame:
    """Levels present per case and bin count (at most bin_count of them) with their moments.

    With ``cases`` the result is placed as the counts are (see glcm_counts).
    """
    if cases is not None and grid.nested(bin_counts):
        top = max(bin_counts)
        lev, large = _levels_by_case(cells, top, cases, [])
        lev = lev.distinct()
        if large is not None:
            lev = lev.unionByName(large.select("case_id", "g").distinct().repartition(cases.tasks, "case_id"))
        arr = F.array(*[F.struct(F.lit(b).alias("bin_count"), grid.coarsen(F.col("g"), top, b).alias("g")) for b in bin_counts])
        lev = lev.select("case_id", F.explode(arr).alias("t")).select("case_id", "t.*").distinct()
    else:
        lev = grid.discretise_many(cells, bin_counts).select("case_id", "bin_count", "g").distinct()
    return lev.groupBy("case_id", "bin_count").agg(
        F.array_sort(F.collect_list("g")).alias("levels"),
        F.count(F.lit(1)).alias("ng_present"),
        F.max("g").alias("ng"),
        F.avg("g").alias("lv_avg"),
        F.stddev_samp("g").alias("lv_sd"),
    )


# ---- run lengths -------------------------------------------------------------------------------

def runs(lev: DataFrame, keys=("case_id", "bin_count")) -> DataFrame:
    """Runs of equal level along the 13 directions: one row per run (keys, angle, line, g, len).

    Each (angle, line) is its own window partition, so a partition is never longer than an axis.
    """
    keys = list(keys)
    offs = grid.offsets((1,))
    e = lev.select(*keys, "z", "y", "x", "g").withColumn("o", F.explode(grid.offset_array(offs)))
    step = F.when(F.col("o.dz") != 0, F.col("z")).when(F.col("o.dy") != 0, F.col("y")).otherwise(F.col("x"))
    e = e.withColumn("t", step)  # position along the direction; the leading component is always +1
    e = e.select(
        *keys, F.col("o.angle").alias("angle"), "g", "t",
        (F.col("z") - F.col("t") * F.col("o.dz")).alias("l0"),
        (F.col("y") - F.col("t") * F.col("o.dy")).alias("l1"),
        (F.col("x") - F.col("t") * F.col("o.dx")).alias("l2"),
    )
    line = [*keys, "angle", "l0", "l1", "l2"]
    w = Window.partitionBy(*line).orderBy("t")
    new = F.coalesce((F.lag("t").over(w) != F.col("t") - 1) | (F.lag("g").over(w) != F.col("g")), F.lit(True))
    e = e.withColumn("new", new.cast("int"))
    e = e.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy(*line, "run").agg(F.first("g").alias("g"), F.count(F.lit(1)).cast("int").alias("len"))


def glrlm_counts(lev: DataFrame, keys=("case_id", "bin_count")) -> DataFrame:
    """(keys, angle, g, len, n); an angle whose lines never hold two region cells is dropped."""
    keys = list(keys)
    line = [*keys, "angle", "l0", "l1", "l2"]
    r = runs(lev, keys)
    per_line = Window.partitionBy(*line)
    r = r.withColumn("cells", F.sum("len").over(per_line))
    c = r.groupBy(*keys, "angle", "g", "len").agg(F.count(F.lit(1)).alias("n"), F.max("cells").alias("cells"))
    keep = F.max("cells").over(Window.partitionBy(*keys, "angle")) > 1  # at most levels x axis rows
    return c.withColumn("keep", keep).where("keep").select(*keys, "angle", "g", "len", "n")


def glrlm_weighted(counts: DataFrame, norm: str, spacing=(1.0, 1.0, 1.0), keys=("case_id", "bin_count")) -> DataFrame:
    """Run-length angles collapsed into one matrix, each weighed by its physical length: angle is 0, n a double."""
    offs = counts.sparkSession.createDataFrame(grid.offsets((1,)), "angle int, dist int, dz int, dy int, dx int")
    w = offs.select("angle", angle_weight(norm, F.col("dz"), F.col("dy"), F.col("dx"), spacing, decay=False).alias("w"))
    out = counts.join(F.broadcast(w), "angle")  # a fixed table of 13 offsets
    return out.groupBy(*keys, "g", "len").agg(F.sum(F.col("n") * F.col("w")).alias("n")).withColumn("angle", F.lit(0))


# ---- dependence and neighbourhood difference ----------------------------------------------------

def neighbour_summary(lev: DataFrame, alpha: int = 0, keys=("case_id", "bin_count"), distances=(1,)) -> DataFrame:
    """Per region cell: neighbours in the region, dependent neighbours, sum of neighbour levels."""
    keys = list(keys)
    offs = grid.offsets(distances, bidirectional=True)
    p = grid.neighbour_pairs(lev.select(*keys, "z", "y", "x", "g"), offs, keys=keys, left=True)
    # grouped by block and cell: already placed by block, so no further exchange
    return p.groupBy(*keys, "bz", "by", "bx", "z", "y", "x", "g").agg(
        F.count("g2").alias("nb"),
        F.count(F.when(F.abs(F.col("g") - F.col("g2")) <= alpha, 1)).alias("dep"),
        F.sum("g2").alias("sum_g2"),
    )


def gldm_counts(lev: DataFrame, alpha: int = 0, keys=("case_id", "bin_count"), distances=(1,)) -> DataFrame:
    s = neighbour_summary(lev, alpha, keys, distances)
    return s.groupBy(*keys, "g", (F.col("dep") + 1).cast("int").alias("dep")).agg(F.count(F.lit(1)).alias("n"))


def ngtdm_table(lev: DataFrame, keys=("case_id", "bin_count"), distances=(1,)) -> DataFrame:
    """(keys, g, n, s): cells per level and the summed distance to the neighbourhood mean."""
    s = neighbour_summary(lev, 0, keys, distances)
    diff = F.when(F.col("nb") == 0, 0.0).otherwise(
        F.abs(F.col("g") - F.try_divide(F.col("sum_g2").cast("double"), F.col("nb").cast("double"))))
    return s.groupBy(*keys, "g").agg(F.count(F.lit(1)).alias("n"), F.sum(diff).alias("s"),
                                     F.count(F.when(F.col("nb") > 0, 1)).alias("n_valid"))
