"""Voxel-table basics: region, boxes, discretisation, offsets and the blocked neighbour join.

A case may hold a third of all cells, so nothing here partitions by case alone: per-case statistics
are plain aggregates (combined map-side) joined back, and cells are placed by *block* - a cube of
2**BLOCK_BITS cells a side - so one volume spreads over many tasks.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 5


def roi(vox: DataFrame, label: int = 1) -> DataFrame:
    return vox.where(F.col("m") == label)


def bounding_box(cells: DataFrame, keys=("case_id",)) -> DataFrame:
    return cells.groupBy(*keys).agg(
        *[f(c).alias(f"{c}{s}") for c in ("z", "y", "x") for f, s in ((F.min, "0"), (F.max, "1"))]
    )


def case_range(cells: DataFrame, keys=("case_id",)) -> DataFrame:
    return cells.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def level_of(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """1-based level: the number of edges lo + k*step (k < bins) that are <= v.

    The division only gives a first guess; the two comparisons against the edges themselves make the
    result exact. A flat region gets edges from lo - 0.5 to lo + 0.5.
    """
    a = F.when(lo == hi, lo - 0.5).otherwise(lo)
    b = F.when(lo == hi, hi + 0.5).otherwise(hi)
    step = (b - a) / float(bins)
    k = F.least(F.greatest(F.floor((v - a) / step), F.lit(0)), F.lit(bins - 1))
    up = (k < bins - 1) & (a + (k + 1) * step <= v)
    down = (k > 0) & (a + k * step > v)
    return (F.when(up, k + 1).when(down, k - 1).otherwise(k) + 1).cast("int")


def discretise(cells: DataFrame, bins: int, keys=("case_id",)) -> DataFrame:
    """Add ``g`` (1..bins) from the per-case range of the given region cells."""
    rng = case_range(cells, keys)
    return cells.join(rng, list(keys)).withColumn("g", level_of(F.col("v"), F.col("lo"), F.col("hi"), bins)).drop(
        "lo", "hi")


def discretise_width(cells: DataFrame, width: float, keys=("case_id",)) -> DataFrame:
    """Fixed-width levels; the region minimum falls in level 1."""
    rng = cells.groupBy(*keys).agg(F.min("v").alias("lo"))
    g = F.floor(F.col("v") / width) - F.floor(F.col("lo") / width) + 1
    return cells.join(rng, list(keys)).withColumn("g", g.cast("int")).drop("lo")


def nested(bin_counts) -> bool:
    """Whether every bin count is the largest one divided by a power of two.

    Then the coarse edges are exactly a subset of the fine ones (scaling by two is exact in binary
    floating point), so coarse levels follow from fine levels by integer division.
    """
    top = max(bin_counts)
    return all(top % b == 0 and ((top // b) & (top // b - 1)) == 0 for b in bin_counts)


def coarsen(g: Column, top: int, bins: int) -> Column:
    return (F.floor((g - 1) / (top // bins)) + 1).cast("int")


def discretise_many(cells: DataFrame, bin_counts, keys=("case_id",)) -> DataFrame:
    """One row per cell and bin count (columns ``bin_count``, ``g``); the range is computed once."""
    rng = case_range(cells, keys)
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    if nested(bin_counts):
        top = max(bin_counts)
        base = cells.join(rng, list(keys)).withColumn("gt", level_of(v, lo, hi, top))
        pairs = [F.struct(F.lit(b).alias("bin_count"), coarsen(F.col("gt"), top, b).alias("g")) for b in bin_counts]
        out = base.drop("lo", "hi")
    else:
        out = cells.join(rng, list(keys))
        pairs = [F.struct(F.lit(b).alias("bin_count"), level_of(v, lo, hi, b).alias("g")) for b in bin_counts]
    out = out.withColumn("bg", F.explode(F.array(*pairs)))
    return out.withColumns({"bin_count": F.col("bg.bin_count"), "g": F.col("bg.g")}).drop("bg", "gt", "lo", "hi")


def parallelism(df: DataFrame) -> int:
    """Task count for stages whose work is far larger than their input (exploded offsets).

    A fixed count keeps adaptive coalescing, which looks at bytes only, from merging them.
    """
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def offsets(distances=(1,), axes=3, bidirectional: bool = False, force2d: int | None = None):
    """(angle, dist, dz, dy, dx): offsets whose infinity norm is a requested distance.

    Ordered from +max to -max, last axis fastest; one-directional keeps the first half, the
    lexicographically positive offsets. Angles are numbered from 0 within each distance.
    """
    out = []
    for d in sorted(distances):
        zs = range(d, -d - 1, -1) if axes == 3 else (0,)
        cand = [o for o in product(zs, range(d, -d - 1, -1), range(d, -d - 1, -1)) if max(map(abs, o)) == d]
        if force2d is not None:
            cand = [o for o in cand if o[force2d] == 0]
        if not bidirectional:
            cand = [o for o in cand if o > (0, 0, 0)]
        out += [(a, d, *o) for a, o in enumerate(cand)]
    return out


def offset_array(offs) -> Column:
    """The offsets as one constant array of structs (at most a few hundred entries)."""
    names = ("angle", "dist", "dz", "dy", "dx")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, o)]) for o in offs])


HALF = 1 << 20  # three coordinates pack into one long
MARGIN = 64     # kept free at both ends, so that a step to a neighbour cannot leave the range


def cell_key(z="z", y="y", x="x") -> Column:
    """One long per cell, 21 bits an axis; adding ``key_step`` moves to the neighbour. Cells too far out raise."""
    axes = [F.col(c).cast("long") for c in (z, y, x)]
    inside = reduce(lambda a, b: a & b, [F.abs(c) < HALF - MARGIN for c in axes])
    part = [c + F.lit(HALF) for c in axes]
    key = F.shiftleft(part[0], 42) + F.shiftleft(part[1], 21) + part[2]
    where = F.concat_ws(", ", *[c.cast("string") for c in axes])
    return F.when(inside, key).otherwise(F.raise_error(F.concat(F.lit("cell outside the range of its key: "), where)).cast("long"))


def key_step(dz: int, dy: int, dx: int) -> int:
    return (dz << 42) + (dy << 21) + dx


def key_axes(key: Column) -> tuple[Column, Column, Column]:
    """The coordinates of a packed cell."""
    mask = F.lit((1 << 21) - 1)
    return tuple((F.shiftright(key, s).bitwiseAND(mask) - HALF).cast("int") for s in (42, 21, 0))


def neighbour_pairs(cells: DataFrame, offs, carry=("g",), keys=("case_id",), left: bool = False,
                    block_bits: int = BLOCK_BITS) -> DataFrame:
    """Cells joined to their neighbours at the given offsets.

    Both sides are placed by block. A cell is its block's own on the centre side; on the neighbour
    side it is also sent to the adjacent blocks that can see it (a thin halo). The offsets are
    exploded after that exchange, so the wide side never crosses the network: it probes a per-task
    hash table of the block's cells. ``carry`` columns of the neighbour come back with suffix ``2``.
    """
    keys = list(keys)
    axes = ("z", "y", "x")
    if max(abs(c) for o in offs for c in o[2:]) > MARGIN:
        raise ValueError(f"offsets reach at most {MARGIN} cells")
    reach = {a: (min(o[2 + i] for o in offs), max(o[2 + i] for o in offs)) for i, a in enumerate(axes)}
    blocks = [f"b{a}" for a in axes]
    centre = cells
    halo = cells.select(*keys, cell_key().alias("cell2"), *axes, *[F.col(c).alias(f"{c}2") for c in carry])
    for a, b in zip(axes, blocks):
        centre = centre.withColumn(b, F.shiftright(a, block_bits))
        lo, hi = reach[a]
        first = F.shiftright(F.col(a) - hi, block_bits)
        last = F.shiftright(F.col(a) - lo, block_bits)
        halo = halo.withColumn(b, first if lo == hi == 0 else F.explode(F.sequence(first, last)))
    place = [*keys, *blocks]
    n = parallelism(cells)
    centre = centre.repartition(n, *place)
    halo = halo.drop(*axes).repartition(n, *place)
    step = F.array(*[F.struct(F.lit(o[0]).alias("angle"), F.lit(o[1]).alias("dist"), F.lit(key_step(*o[2:])).alias("step"))
                     for o in offs])
    centre = centre.withColumn("o", F.explode(step)).withColumns(
        {"angle": F.col("o.angle"), "dist": F.col("o.dist"), "cell2": cell_key() + F.col("o.step")}).drop("o")
    # a hash join, not sort-merge: sorting would handle every exploded row
    out = centre.join(halo.hint("shuffle_hash"), [*place, "cell2"], "left" if left else "inner")
    z2, y2, x2 = key_axes(F.col("cell2"))
    return out.withColumns({"z2": z2, "y2": y2, "x2": x2}).drop("cell2")
