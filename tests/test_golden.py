"""Worked grids with known matrices and features."""

import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import GRID_A, GRID_B
from voxelframe.operators import components, cooccurrence, emphasis, grid, texture, weighted

KEYS = ["case_id", "bin_count"]


def angle_of(dz, dy, dx):
    return next(o[0] for o in grid.offsets((1,)) if o[2:] == (dz, dy, dx))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_offset_counts():
    assert [len(grid.offsets((d,))) for d in (1, 2, 3)] == [13, 49, 109]
    assert len(grid.offsets((1,), bidirectional=True)) == 26
    assert len(grid.offsets((1,), force2d=0)) == 4


def test_run_lengths(grid_levels):
    c = texture.glrlm_counts(grid_levels(GRID_A)).where(F.col("angle") == angle_of(0, 0, 1))
    assert rows(c, "g", "len", "n") == [(1, 1, 1), (1, 3, 1), (2, 1, 3), (2, 3, 1), (3, 1, 4), (3, 2, 1), (3, 3, 1),
                                        (4, 1, 1), (4, 2, 1), (5, 1, 3)]


def test_run_features(grid_levels):
    c = texture.glrlm_counts(grid_levels(GRID_A)).where(F.col("angle") == angle_of(0, 0, 1)).withColumnRenamed("len", "j")
    f = emphasis.cell_features(c, KEYS, emphasis.run_length(), angle=True).first()
    assert f["ShortRunEmphasis"] == pytest.approx(0.7549019608)
    assert f["LongRunEmphasis"] == pytest.approx(2.7647058824)
    assert f["RunPercentage"] == pytest.approx(0.68)


def test_flat_axis_is_no_run_direction(grid_levels):
    angles = {r[0] for r in texture.glrlm_counts(grid_levels(GRID_A)).select("angle").distinct().collect()}
    assert angles == {angle_of(0, 1, 1), angle_of(0, 1, 0), angle_of(0, 1, -1), angle_of(0, 0, 1)}


def test_dependence(grid_levels):
    c = texture.gldm_counts(grid_levels(GRID_A))
    assert rows(c, "g", "dep", "n") == [(1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 1, 1), (2, 2, 2), (2, 3, 3), (3, 1, 1), (3, 2, 4),
                                        (3, 3, 4), (4, 1, 1), (4, 2, 2), (5, 1, 3)]
    f = emphasis.cell_features(c.withColumnRenamed("dep", "j"), KEYS, emphasis.dependence()).first()
    assert f["SmallDependenceEmphasis"] == pytest.approx(0.3725, abs=5e-5)
    assert f["LargeDependenceEmphasis"] == pytest.approx(5.56)


def test_cooccurrence(grid_levels):
    c = texture.glcm_of_levels(grid_levels(GRID_A)).where(F.col("angle") == angle_of(0, 0, 1))
    assert rows(c, "i", "j", "n") == [
        (1, 1, 4), (1, 2, 1), (1, 3, 3), (2, 1, 1), (2, 2, 4), (2, 3, 2), (2, 4, 1), (2, 5, 2), (3, 1, 3), (3, 2, 2),
        (3, 3, 6), (3, 5, 2), (4, 2, 1), (4, 4, 2), (4, 5, 1), (5, 2, 2), (5, 3, 2), (5, 4, 1)]
    pv = cooccurrence.with_variants(texture.normalise(c))
    assert cooccurrence.angle_mean(pv, cooccurrence.contrast()).first()["f_origin"] == pytest.approx(2.3)
    d = cooccurrence.angle_mean(cooccurrence.difference_mass(pv), cooccurrence.dissimilarity()).first()
    assert d["f_origin"] == pytest.approx(1.1)


def test_zones(grid_levels):
    z = components.zone_counts(grid_levels(GRID_A))
    assert rows(z, "g", "size", "n") == [(1, 4, 1), (2, 1, 1), (2, 5, 1), (3, 1, 1), (3, 3, 1), (3, 5, 1), (4, 1, 1), (4, 2, 1),
                                         (5, 1, 3)]


def test_neighbourhood_difference(grid_levels):
    t = texture.ngtdm_table(grid_levels(GRID_B))
    got = {r["g"]: (r["n"], r["s"]) for r in t.collect()}
    assert {g: n for g, (n, _) in got.items()} == {1: 6, 2: 2, 3: 4, 5: 4}
    assert got[1][1] == pytest.approx(13.35)
    assert got[2][1] == pytest.approx(2.0)
    assert got[3][1] == pytest.approx(3.0333, abs=1e-4)
    assert got[5][1] == pytest.approx(10.075)
    assert emphasis.ngtdm_features(t, KEYS).first()["Coarseness"] == pytest.approx(0.1171875, abs=1e-6)


def test_first_order(grid_levels):
    b = weighted.block(weighted.collapse(grid_levels(GRID_A), ["case_id"]), ["case_id"]).first()
    want = {"Mean": 2.8, "Median": 3, "Variance": 1.44, "Skewness": 0.25, "Deciles_p_10": 1, "25Percentile": 2, "75Percentile": 3,
            "Deciles_p_90": 4.6, "Energy": 232, "Uniformity": 0.2416, "Entropy": 2.1819011889, "Mode": 3}
    for k, v in want.items():
        assert b[k] == pytest.approx(v, abs=1e-9), k


def test_fixed_width_levels(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (54, 74.9, 75, 100, 149, 166)], "case_id long, v double")
    got = {r["v"]: r["g"] for r in grid.discretise_width(df, 25.0).collect()}
    assert got == {54.0: 1, 74.9: 1, 75.0: 2, 100.0: 3, 149.0: 4, 166.0: 5}


def test_bin_edges(spark):
    from voxelframe.plans.q_voxel import bin_edges

    df = spark.createDataFrame([(1, 54.0), (1, 166.0), (2, 7.0)], "case_id long, v double")
    e = [r["edge"] for r in bin_edges(df.where("case_id = 1"), width=25.0).orderBy("k").collect()]
    assert e == [50, 75, 100, 125, 150, 175, 200]
    flat = [r["edge"] for r in bin_edges(df.where("case_id = 2"), bins=2).orderBy("k").collect()]
    assert flat == [6.5, 7.0, 8.5]


def test_flat_region(spark):
    cells = spark.createDataFrame([(1, 0, y, x, 4.0, 1) for y in range(3) for x in range(3)],
                                  "case_id long, z int, y int, x int, v double, m int")
    c = texture.glcm_counts(cells, (8,), (1,))
    assert {(r["i"], r["j"]) for r in c.collect()} == {(5, 5)}  # the middle of edges v - 0.5 .. v + 0.5
    assert cooccurrence.feature("Imc1", cells).first()["value"] == 0
    assert cooccurrence.feature("Imc2", cells).first()["value"] == 0
    assert cooccurrence.feature("Gaussian", cells).first()["f_origin_nd_0_inv_0"] == 0
    assert math.isclose(cooccurrence.feature("SumAverage", cells).first()["inv_0"], 10.0)
