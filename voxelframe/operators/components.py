"""Connected components of the region by star contraction over neighbour edges.

Rounds alternate between sending every larger neighbour to a vertex's smallest neighbour and sending
every smaller neighbour to it; the number of rounds grows with the logarithm of the component size.
Each round is two equi-joins and map-side combined minima; lineage is cut by a reliable checkpoint.
Keys whose cells fit a task need no rounds: their cells meet once and are hooked and contracted there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.operators import grid
from voxelframe.session import cut_lineage, stage

LOCAL_CELLS = 1 << 17  # a key of at most so many cells is solved in one task
TASK_CELLS = 1 << 18   # cells of a task, unless one key has more


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (k, u, w): u's neighbours w point to the smallest of them and u."""
    both = edges if not large else edges.unionByName(
        edges.select("k", F.col("w").alias("u"), F.col("u").alias("w")))
    low = both.groupBy("k", "u").agg(F.least(F.min("w"), F.first("u")).alias("lowest"))
    j = both.join(low, ["k", "u"])
    if large:
        out = j.where("w > u").select("k", F.col("w").alias("u"), F.col("lowest").alias("w"))
    else:
        linked = j.where("w <> lowest").select("k", F.col("w").alias("u"), F.col("lowest").alias("w"))
        own = low.where("lowest < u").select("k", "u", F.col("lowest").alias("w"))
        out = linked.unionByName(own)
    return out.where("u <> w").distinct()


def _fingerprint(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("k", "u", "w")), F.lit(0))).first()


def contract(edges: DataFrame) -> DataFrame:
    """(k, u, w): every non-minimal vertex u with the smallest vertex w of its component.

    Rounds go on until one changes nothing: the labels only fall, so that is reached whatever the graph.
    """
    cur = cut_lineage(edges.select("k", F.greatest("u", "w").alias("u"), F.least("u", "w").alias("w"))
                      .where("u <> w").distinct())
    last = None
    while True:
        cur = cut_lineage(_star(_star(cur, True), False))
        now = _fingerprint(cur)
        if now == last:
            return cur
        last = now


def _solver(steps, same: str | None):
    """Of the cells of one key: ``comp``, their own ids, becomes the smallest id of their component. Pickled whole for the workers."""
    def roots(cell, value):
        order = np.argsort(cell, kind="stable")
        at = cell[order]
        value = None if value is None else value[order]
        ends = []
        for r in range(int(np.unique(at, return_counts=True)[1].max())):  # more than once only where a cell is repeated
            for step in (0, *steps) if r else steps:
                pos = np.searchsorted(at, at + step) + r
                hit = np.flatnonzero(pos < len(at))
                hit = hit[at[pos[hit]] == at[hit] + step]
                if value is not None and step:
                    hit = hit[value[hit] == value[pos[hit]]]
                ends.append((hit, pos[hit]))
        a, b = (np.concatenate(x) for x in zip(*ends))
        root = np.arange(len(at))
        while True:
            u, w = root[a], root[b]
            apart = u != w
            if not apart.any():
                break
            a, b, u, w = a[apart], b[apart], u[apart], w[apart]
            np.minimum.at(root, np.maximum(u, w), np.minimum(u, w))
            while not np.array_equal(next_ := root[root], root):
                root = next_
        out = np.empty_like(cell)
        out[order] = at[root]
        return out

    def solve(table):
        import pyarrow as pa

        comp = roots(table["comp"].to_numpy(), table[same].to_numpy() if same else None)
        return table.set_column(table.schema.get_field_index("comp"), "comp", pa.array(comp, pa.int64()))

    return solve


def components(cells: DataFrame, keys=("case_id",), same: str | None = None) -> DataFrame:
    """Cells with ``comp``, the smallest cell id of their 26-neighbour component.

    With ``same`` only neighbours of equal value of that column connect (zones of one level).
    """
    keys = list(keys)
    sizes = stage(cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    total, largest = sizes.agg(F.sum(F.least("_n", F.lit(LOCAL_CELLS))), F.max("_n")).first()
    if (largest or 0) <= LOCAL_CELLS:
        return _local(cells, keys, same, total or 0)
    ids = F.broadcast(sizes.where(F.col("_n") > LOCAL_CELLS).select(*keys))  # at most one key in LOCAL_CELLS cells
    return _local(cells.join(ids, keys, "left_anti"), keys, same, total).unionByName(_spread(cells.join(ids, keys, "left_semi"), keys, same))


def _local(cells: DataFrame, keys, same: str | None, total: int) -> DataFrame:
    tasks = max(cells.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_CELLS))
    steps = [grid.key_step(*o[2:]) for o in grid.offsets((1,))]
    placed = cells.withColumn("comp", grid.cell_key()).repartition(tasks, *keys)
    return placed.groupBy(*keys).applyInArrow(_solver(steps, same), placed.schema)


def _spread(cells: DataFrame, keys, same: str | None) -> DataFrame:
    carry = [same] if same else []
    offs = grid.offsets((1,))
    p = grid.neighbour_pairs(cells.select(*keys, "z", "y", "x", *carry), offs, carry=carry, keys=keys)
    if same:
        p = p.where(F.col(same) == F.col(f"{same}2"))
    edges = p.select(F.struct(*keys).alias("k"), grid.cell_key().alias("u"), grid.cell_key("z2", "y2", "x2").alias("w"))
    stars = contract(edges)
    out = cells.withColumn("u", grid.cell_key()).withColumn("k", F.struct(*keys))
    return out.join(stars, ["k", "u"], "left").withColumn("comp", F.coalesce("w", "u")).drop("k", "u", "w")


def zone_counts(lev: DataFrame, keys=("case_id", "bin_count")) -> DataFrame:
    """(keys, g, size, n): zones of equal level by size."""
    keys = list(keys)
    z = components(lev.select(*keys, "z", "y", "x", "g"), keys, same="g")
    per = z.groupBy(*keys, "comp", "g").agg(F.count(F.lit(1)).cast("int").alias("size"))
    return per.groupBy(*keys, "g", "size").agg(F.count(F.lit(1)).alias("n"))
