"""Recursive filters and spline resampling against dense numpy."""

import numpy as np
import pytest

from voxelframe.operators import filters, recursive
from voxelframe.plans.q_voxel import _spline_matrix

CELL = "case_id int, z int, y int, x int, v double, m int"
GEO = "case_id int, nz int, ny int, nx int, dz double, dy double, dx double"


def line_table(spark, values, case=1):
    return spark.createDataFrame([(case, 0, 0, k, None if v is None else float(v), 1) for k, v in enumerate(values)], CELL)


def cube(spark, v):
    return spark.createDataFrame([(1, z, y, x, float(v[z, y, x]), 1) for z, y, x in np.ndindex(*v.shape)], CELL)


def along_x(df, *args, **kw):
    out = recursive.along(filters._boxed(df, ["case_id"]), "x", *args, line=["case_id", "z", "y"], **kw)
    return {(r.case_id, r.x): r for r in out.collect()}


@pytest.mark.parametrize("width, n", [(0.7, 1000), (3.0, 1700), (3.0, 5), (1.0, 1)])
def test_lines_over_many_blocks(spark, width, n):
    """Lines of several blocks, shorter than the halo and of one cell; edges repeat."""
    v = np.random.default_rng(n).normal(size=n) * 10.0 ** np.random.default_rng(1).integers(-3, 4, n)
    poles, outs = recursive.gaussian(width)
    halo, _ = recursive.reach(poles)
    got = along_x(line_table(spark, v), poles, outs)
    assert len(got) == n
    ext = np.pad(v, halo, mode="edge")
    for k, c in enumerate(outs):
        h = recursive.response(poles, c, np.arange(-halo, halo + 1))
        want = np.convolve(ext, h, "valid")
        np.testing.assert_allclose([got[1, x][f"v{k}"] for x in range(n)], want, atol=1e-9 * np.abs(ext).max())


@pytest.mark.parametrize("width", [1.0, 2.0, 5.0])
def test_gaussian_kernels(width):
    """Close to the sampled kernels; a square comes out as itself plus the variance, its second derivative as 2."""
    poles, (g, h) = recursive.gaussian(width)
    k = np.arange(-recursive.reach(poles)[0], recursive.reach(poles)[0] + 1)
    t = np.exp(-k * k / (2 * width ** 2))
    t /= t.sum()
    assert np.abs(recursive.response(poles, g, k) - t).max() < 2e-4 * t.max()
    assert (recursive.response(poles, g, k) * (7 - k) ** 2).sum() == pytest.approx(49 + width ** 2)
    assert (recursive.response(poles, h, k) * (7 - k) ** 2).sum() == pytest.approx(2)


@pytest.mark.parametrize("sigma", [1.0, 3.0, 5.0])
def test_log_agrees_with_truncated_taps(spark, sigma):
    v = np.random.default_rng(2).normal(size=(7, 6, 8))
    df = cube(spark, v)
    a, b = ({(r.z, r.y, r.x): (r.v, r.m) for r in filters.log_sigma(df, sigma, how=h).collect()} for h in ("taps", "recursive"))
    assert a.keys() == b.keys() and len(a) == v.size
    assert max(abs(a[k][0] - b[k][0]) for k in a) < 1e-3 and {m for _, m in b.values()} == {1}


@pytest.mark.parametrize("n", [1, 2, 3, 30, 900])
def test_spline_coefficients(spark, n):
    """A dense solve of the mirrored system, over several blocks for 900 cells."""
    v = np.random.default_rng(n).normal(size=n)
    got = along_x(line_table(spark, v), *recursive.SPLINE, border="mirror")
    fold = [0 if n == 1 else min(j % (2 * n - 2), 2 * n - 2 - j % (2 * n - 2)) for j in range(-1, n + 1)]
    m = np.zeros((n, n))
    for r in range(n):
        for o, w in ((0, 1 / 6), (1, 2 / 3), (2, 1 / 6)):
            m[r, fold[r + o]] += w
    np.testing.assert_allclose([got[1, x]["v"] for x in range(n)], np.linalg.solve(m, v), atol=1e-12)


def test_spline_resampling(spark):
    """A dense product per axis; one axis has one slice, one keeps its spacing."""
    v = np.random.default_rng(3).normal(size=(1, 5, 7))
    geo = spark.createDataFrame([(1, 1, 5, 7, 2.0, 1.0, 1.5)], GEO)
    rows = filters.resample(cube(spark, v), geo, (1.0, 0.0, 1.0), "spline").collect()
    places = [min(max((t + 0.5) / 1.5 - 0.5, 0.0), 6.0) for t in range(11)]
    want = np.einsum("zyx,tx->zyt", v, np.array(_spline_matrix(7, places)))
    assert len(rows) == want.size
    for r in rows:
        assert r.v == pytest.approx(want[r.z, r.y, r.x], abs=1e-10)


def test_spline_passes_through_cells_and_keeps_cubics(spark):
    x = np.arange(60.0)
    v = 0.01 * (x - 30) ** 3 - 0.2 * x * x + x
    df = line_table(spark, v)
    geo = spark.createDataFrame([(1, 1, 1, 60, 1.0, 1.0, 1.0)], GEO)
    same = {r.x: r.v for r in filters.resample(df, geo, (0.0, 0.0, 0.0), "spline").collect()}
    np.testing.assert_allclose([same[k] for k in range(60)], v, atol=1e-10 * np.abs(v).max())
    fine = {r.x: r.v for r in filters.resample(df, geo, (0.0, 0.0, 0.5), "spline").collect()}
    assert len(fine) == 120
    for t in range(50, 70):  # the mirrored ends are not cubic; their trace fades by a factor of 3.7 a cell
        p = (t + 0.5) * 0.5 - 0.5
        assert fine[t] == pytest.approx(0.01 * (p - 30) ** 3 - 0.2 * p * p + p, abs=1e-6)


def test_nulls_repeats_and_empty_tables(spark):
    """A null counts as 0, other columns pass through, an empty table gives no rows, an unknown mode raises."""
    poles, outs = recursive.gaussian(1.0)
    df = line_table(spark, [1.0, None, 4.0]).unionByName(line_table(spark, [2.0, 2.0], case=2))
    zero = line_table(spark, [1.0, 0.0, 4.0]).unionByName(line_table(spark, [2.0, 2.0], case=2))
    a, b = along_x(df, poles, outs[:1]), along_x(zero, poles, outs[:1])
    assert {k: r["v"] for k, r in a.items()} == {k: r["v"] for k, r in b.items()} and a[2, 0]["v"] == pytest.approx(2.0)
    assert along_x(df.where("case_id > 5"), poles, outs) == {}
    geo = spark.createDataFrame([(1, 1, 1, 3, 1.0, 1.0, 1.0)], GEO)
    assert filters.resample(df.where("case_id > 5"), geo, (1.0, 1.0, 0.5), "spline").count() == 0
    with pytest.raises(ValueError):
        filters.resample(df, geo, (1.0, 1.0, 0.5), "bicubic")
    with pytest.raises(ValueError):
        filters.log_sigma(df, 1.0, how="exact")


def test_spline_of_a_small_case_exchanges_its_cells_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(c, z, y, x, float((3 * c + 5 * z * z + 7 * y + x * x) % 11)) for c in range(3) for z in range(4) for y in range(1 + c) for x in range(5)]
    vox = spark.createDataFrame(rows, "case_id long, z int, y int, x int, v double")
    geo = vox.groupBy("case_id").agg(*[(F.max(a) + 1).cast("int").alias(f"n{a}") for a in "zyx"]).withColumns(
        {f"{p}{a}": F.lit(x) for a, s in zip("zyx", (2.0, 1.0, 1.0)) for p, x in (("d", s), ("o", 0.0))})
    run = lambda: filters.resample(vox, geo, (1.0, 0.8, 0.0), "spline")
    plan = run()._jdf.queryExecution().executedPlan().toString()
    found = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert found and all("REPARTITION_BY_NUM" in line for line in found) and plan.count("Exchange hashpartitioning(") <= 5
    got = {tuple(r)[:4]: r["v"] for r in run().collect()}
    for limit in (0, 60):  # none, or some of the cases fit a task
        monkeypatch.setattr(filters, "LOCAL_CELLS", limit)
        far = {tuple(r)[:4]: r["v"] for r in run().collect()}
        assert far.keys() == got.keys() and all(abs(far[k] - got[k]) < 1e-9 for k in got)
