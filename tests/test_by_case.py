"""Co-occurrence of cases that fit a task is counted where their cells are."""

import re

import pytest
from pyspark.sql import functions as F

from voxelframe.operators import cooccurrence as co
from voxelframe.operators import grid, texture

BINS, DISTS = (2, 4, 8), (1, 2)


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(c, z, y, x, float((7 * c + 5 * z + 3 * y * y + 11 * x * z) % 13), 1) for c in range(4) for z in range(2 + c) for y in range(3) for x in range(4)]
    rows.append((9, 0, 0, 0, 1.0, 1))  # a case without a pair
    return spark.createDataFrame(rows, "case_id long, z int, y int, x int, v double, m int")


def exchanges(df):
    return re.findall(r"Exchange \w+partitioning\(.*", df._jdf.queryExecution().executedPlan().toString())


def table(df):
    return sorted(tuple(r) for r in df.collect())


FEATURES = ("Contrast", "Average", "Autocorrelation", "Correlation", "DifferenceAverage", "DifferenceEnergy", "DifferenceEntropy",
            "DifferenceVariance", "Dissimilarity", "Dmn", *co.GAUSSIANS)


@pytest.mark.parametrize("name", FEATURES)
def test_no_pair_of_a_small_case_is_exchanged(cells, name):
    for e in exchanges(co.feature(name, cells, BINS, DISTS)):
        assert not re.search(r"dist#|angle#|[ (][ij]#", e), e


def test_no_pair_is_exchanged_for_the_dense_and_the_weighted_matrix(cells):
    found = exchanges(co.dense(cells, BINS, DISTS)) + exchanges(co.covariance(co.with_variants(texture.normalise(
        texture.glcm_counts(cells, BINS, DISTS, totals=True)))))
    found += exchanges(texture.glcm_weighted(texture.glcm_counts(cells, BINS, DISTS), "euclidean", DISTS))
    assert found
    for e in found:
        assert not re.search(r"dist#|angle#|[ (][ij]#", e), e


@pytest.mark.parametrize("symmetric", (True, False))
def test_counts_against_a_plain_loop(cells, symmetric):
    got = {tuple(r)[:-1]: r["n"] for r in texture.glcm_counts(cells, BINS, DISTS, symmetric).collect()}
    want = {}
    for b in BINS:
        lev = {}
        for r in grid.discretise(cells, b).collect():
            lev.setdefault(r["case_id"], {})[r["z"], r["y"], r["x"]] = r["g"]
        for c, at in lev.items():
            for angle, d, *o in grid.offsets(DISTS):
                for p, g in at.items():
                    if (h := at.get(tuple(a + s for a, s in zip(p, o)))) is not None:
                        for i, j in ((g, h), (h, g)) if symmetric else ((g, h),):
                            k = (c, b, d, angle, i, j)
                            want[k] = want.get(k, 0) + 1
    assert got == want


@pytest.mark.parametrize("limit", (0, 40))
def test_cases_too_large_for_a_task_give_the_same(cells, monkeypatch, limit):
    build = {
        "contrast": lambda: co.feature("Contrast", cells, BINS, DISTS), "gaussian": lambda: co.feature("Gaussian", cells, BINS, DISTS),
        "dense": lambda: co.dense(cells, BINS, DISTS), "counts": lambda: texture.glcm_counts(cells, BINS, DISTS, totals=True)}
    want = {k: table(f()) for k, f in build.items()}
    monkeypatch.setattr(texture, "LOCAL_CELLS", limit)  # 24 to 60 cells a case
    for k, f in build.items():
        got = table(f())
        assert len(got) == len(want[k])
        for x, y in zip(got, want[k]):
            assert x == pytest.approx(y, rel=1e-9, nan_ok=True)


def test_tasks_follow_the_pairs(cells, monkeypatch):
    monkeypatch.setattr(texture, "TASK_PAIRS", 100)
    few = texture.measure_cases(cells, (1,))
    assert few.tasks == -(-cells.count() * 13 // 100) and few.largest == 60
    assert texture.measure_cases(cells.where(F.lit(False)), (1,)).largest == 0
    assert texture.glcm_counts(cells.where(F.lit(False)), BINS, DISTS).count() == 0


def test_a_matrix_read_once_is_not_written(spark, cells, monkeypatch):
    from voxelframe.operators import extract

    written = []
    for module in (extract, co):
        monkeypatch.setattr(module, "stage", lambda df, name, put=module.stage: (written.append(name), put(df, name))[1])
    one = extract.glcm(cells, BINS, DISTS, wanted=("Contrast",), dense=False)
    assert written == ["glcm-batch"]
    two = extract.glcm(cells, BINS, DISTS, wanted=("Contrast", "DifferenceEntropy"), dense=False)
    assert "glcm" in written
    got, want = ({(r["case_id"], r["feature"]): r["value"] for r in t.collect()} for t in (one, two.where("feature LIKE 'glcm_Contrast%'")))
    assert got == pytest.approx(want)
    assert co.in_one_pass(("Contrast", "Average")) and co.in_one_pass(("Variance",))
    assert not co.in_one_pass(("Cluster",)) and not co.in_one_pass(co.FORMULAS) and not co.in_one_pass(("Contrast", "Variance"))
