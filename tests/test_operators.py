"""Operators against plain Python on small random data, and invariants."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import (analyze, components, cooccurrence, evaluate, extract, filters, grid, mesh, nearest, ordering,
                                  select, tabular, texture, weighted)

CELL = "case_id long, z int, y int, x int, v double, m int"


@pytest.fixture(scope="module")
def volume():
    rnd = random.Random(7)
    # wide enough to cross block borders in x, with holes and negative coordinates
    return [(c, z, y, x, round(rnd.gauss(0, 1), 3), 1) for c in (1, 2) for z in range(-1, 2) for y in range(3)
            for x in range(30, 36) if rnd.random() < 0.8]


@pytest.fixture(scope="module")
def cells(spark, volume):
    return spark.createDataFrame(volume, CELL)


def levels_of(volume, bins):
    out = {}
    for c in {r[0] for r in volume}:
        vs = [r[4] for r in volume if r[0] == c]
        lo, hi = min(vs), max(vs)
        for r in volume:
            if r[0] == c:
                out[r[:4]] = sum(lo + k * ((hi - lo) / bins) <= r[4] for k in range(bins))
    return out


def test_levels_and_nesting(cells, volume):
    bins = (2, 4, 8, 32, 64)
    got = {(r["bin_count"], r["case_id"], r["z"], r["y"], r["x"]): r["g"] for r in grid.discretise_many(cells, bins).collect()}
    for b in bins:
        for k, g in levels_of(volume, b).items():
            assert got[(b, *k)] == g
    odd = {(r["bin_count"], r["case_id"], r["z"], r["y"], r["x"]): r["g"] for r in grid.discretise_many(cells, (3, 5)).collect()}
    for b in (3, 5):
        for k, g in levels_of(volume, b).items():
            assert odd[(b, *k)] == g


@pytest.mark.parametrize("bits", [1, 5])
def test_neighbours_cross_blocks(cells, volume, bits):
    offs = grid.offsets((1, 2))
    p = grid.neighbour_pairs(cells.select("case_id", "z", "y", "x", "v"), offs, carry=("v",), block_bits=bits)
    got = Counter((r["case_id"], r["z"], r["y"], r["x"], r["z2"], r["y2"], r["x2"], r["v2"]) for r in p.collect())
    at = {r[:4]: r[4] for r in volume}
    want = Counter()
    for (c, z, y, x) in at:
        for _, _, dz, dy, dx in offs:
            k = (c, z + dz, y + dy, x + dx)
            if k in at:
                want[(c, z, y, x, *k[1:], at[k])] += 1
    assert got == want


@pytest.mark.parametrize("bins", [(2, 8), (3, 5)])
def test_cooccurrence_counts(cells, volume, bins):
    got = {(r["bin_count"], r["case_id"], r["dist"], r["angle"], r["i"], r["j"]): r["n"]
           for r in texture.glcm_counts(cells, bins, (1, 2), symmetric=True).collect()}
    want = Counter()
    for b in bins:
        lv = levels_of(volume, b)
        for (c, z, y, x), g in lv.items():
            for a, d, dz, dy, dx in grid.offsets((1, 2)):
                h = lv.get((c, z + dz, y + dy, x + dx))
                if h:
                    want[(b, c, d, a, g, h)] += 1
                    want[(b, c, d, a, h, g)] += 1
    assert got == dict(want)


def test_invariants(cells, volume):
    n = Counter(r[0] for r in volume)
    p = texture.normalise(texture.glcm_counts(cells, (8,), (1,)))
    for r in p.groupBy("case_id", "angle").agg(F.sum("p").alias("s")).collect():
        assert r["s"] == pytest.approx(1.0)
    lev = grid.discretise_many(cells, (4,))
    for r in texture.runs(lev).groupBy("case_id", "angle").agg(F.sum("len").alias("s")).collect():
        assert r["s"] == n[r["case_id"]]
    for r in texture.gldm_counts(lev).groupBy("case_id").agg(F.sum("n").alias("s")).collect():
        assert r["s"] == n[r["case_id"]]
    for r in components.zone_counts(lev).groupBy("case_id").agg(F.sum(F.col("n") * F.col("size")).alias("s")).collect():
        assert r["s"] == n[r["case_id"]]


def test_components_on_a_long_snake(spark):
    path = [(0, y, x) for y in range(0, 12, 2) for x in range(40)]
    path += [(0, y, 39 if (y // 2) % 2 == 0 else 0) for y in range(1, 11, 2)]
    far = [(0, 30, x) for x in range(5)]
    df = spark.createDataFrame([(1, *p) for p in path + far], "case_id long, z int, y int, x int")
    got = components.components(df).groupBy("comp").count().collect()
    assert sorted(r["count"] for r in got) == [5, len(path)]


def brute_stats(v):
    v = np.sort(np.asarray(v, float))
    d = v - v.mean()
    m = np.abs(v - np.median(v))
    a, b = np.percentile(v, 10), np.percentile(v, 90)
    kept = v[(v >= a) & (v <= b)]
    cut = int(0.1 * len(v))
    return {"Mean": v.mean(), "Median": np.median(v), "25Percentile": np.percentile(v, 25), "Kurtosis": (d ** 4).mean() / (d ** 2).mean() ** 2,
            "Skewness": (d ** 3).mean() / (d ** 2).mean() ** 1.5, "MedianAbsoluteDeviation": 1.4826 * np.median(m),
            "MedianAbsoluteDeviationFromMean": np.median(np.abs(d)), "MaxAbsoluteDeviationFromMedian": m.max(),
            "RobustMeanAbsoluteDeviation": np.abs(kept - kept.mean()).mean(), "TrimmedMean_p_0.1": v[cut:len(v) - cut].mean(),
            "Deciles_p_70": np.percentile(v, 70), "GeoMean3": math.exp(np.log(v + (abs(v[0]) + 1 if v[0] <= 0 else 0)).mean()),
            "RootMeanSquared": math.sqrt((v ** 2).mean()), "L2Norm": math.sqrt((v ** 2).sum())}


@pytest.mark.parametrize("fill", [2, ordering.FILL])
def test_ranked_statistics(spark, fill, monkeypatch):
    rnd = random.Random(3)
    groups = {1: [round(rnd.gauss(0, 2), 1) for _ in range(157)], 2: [5.0] * 4 + [1.0], 3: [rnd.random() ** 6 * 1e6 for _ in range(60)]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "case_id long, v double")
    monkeypatch.setattr(ordering.running, "__defaults__", (False, fill, True))
    for r in weighted.block(weighted.collapse(df, ["case_id"]), ["case_id"]).collect():
        for name, want in brute_stats(groups[r["case_id"]]).items():
            assert r[name] == pytest.approx(want, rel=1e-9, abs=1e-9), (r["case_id"], name)


def test_dense_statistics_count_the_empty_cells(cells):
    p = texture.normalise(texture.glcm_counts(cells, (4,), (1,)))
    vw = cooccurrence.dense_values(p, texture.glcm_levels(cells, (4,)))
    na = {r["case_id"]: r["a"] for r in p.groupBy("case_id").agg(F.countDistinct("angle").alias("a")).collect()}
    for r in vw.groupBy("case_id").agg(F.sum("w").alias("w"), F.sum(F.col("v") * F.col("w")).alias("s")).collect():
        assert r["w"] == 16 * na[r["case_id"]]
        assert r["s"] == pytest.approx(na[r["case_id"]])


def test_mesh_of_known_solids(spark):
    one = [(1, 1, 0, 0, 0, 1)]
    cube = [(2, z, y, x, 0, 1) for z in range(3) for y in range(3) for x in range(3)]
    ball = [(3, z, y, x, 0, 1) for z in range(-12, 13) for y in range(-12, 13) for x in range(-12, 13) if z * z + y * y + x * x <= 144]
    rows = [(1, 0, 0, 0, 0.0, 1)] + [(c, z, y, x, 0.0, 1) for c, z, y, x, _, _ in cube + ball]
    df = spark.createDataFrame(rows, CELL)
    got = {r["case_id"]: r for r in mesh.surface(df, ["case_id"], grid.bounding_box(df)).collect()}
    assert got[1]["area"] == pytest.approx(math.sqrt(3)) and got[1]["volume"] == pytest.approx(1 / 6)
    assert got[3]["volume"] == pytest.approx(4 / 3 * math.pi * 12 ** 3, rel=0.02)
    assert got[3]["area"] == pytest.approx(4 * math.pi * 144, rel=0.12)
    assert 23 < got[2]["volume"] < 27


def test_mesh_is_closed():
    for rows in (mesh.mesh_rows((1.0, 1.0, 1.0)), mesh.mesh_rows((2.0, 1.0, 0.5))):
        t = {r[0]: r for r in rows}
        one = [t[1 << k] for k in range(8)]  # the eight cubes around a single cell
        assert np.allclose(np.sum([r[3:] for r in one], axis=0), 0)


def test_max_distance_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = [(c, float(rnd.randint(0, 30)), float(rnd.randint(0, 20)), float(rnd.randint(0, 9))) for c in (1, 2) for _ in range(300)]
    df = spark.createDataFrame(rows, "case_id long, z double, y double, x double")
    got = {r["case_id"]: r["dist"] for r in mesh.max_distance(df, ["case_id"]).collect()}
    for c in (1, 2):
        p = np.array([r[1:] for r in rows if r[0] == c])
        assert got[c] == pytest.approx(np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)).max())


def test_wavelet_keeps_a_constant(spark):
    df = spark.createDataFrame([(1, z, y, x, 2.0, 1) for z in range(2) for y in range(3) for x in range(4)], CELL)
    got = defaultdict(set)
    for r in filters.wavelet(df).collect():
        got[r["image_type"]].add(round(r["v"], 6))
    low = 2.0 * sum(filters.COIF1) ** 3
    assert got.pop("wavelet-LLL") == {round(low, 6)}
    assert len(got) == 7 and all(abs(v) < 1e-6 for s in got.values() for v in s)


def test_log_of_a_ramp_is_flat_inside(spark):
    df = spark.createDataFrame([(1, z, y, x, float(x), 1) for z in range(12) for y in range(12) for x in range(12)], CELL)
    out = {(r["z"], r["y"], r["x"]): r["v"] for r in filters.log_sigma(df, 1.0).collect()}
    assert len(out) == 12 ** 3 and abs(out[(6, 6, 6)]) < 1e-6
    assert filters.log_sigma(df.where("z < 3"), 1.0).count() == 0  # an axis shorter than 4


def test_polygon_square(spark):
    pts = [(1, 0, 0, k, float(x), float(y)) for k, (x, y) in enumerate(((2, 2), (6, 2), (6, 5), (2, 5)))]
    df = spark.createDataFrame(pts, "region int, slice int, contour int, ord int, px double, py double")
    got = {(r["y"], r["x"]) for r in filters.polygon_fill(df).collect()}
    assert got == {(y, x) for y in range(2, 6) for x in range(2, 7)}


def test_running_totals(spark):
    rnd = random.Random(1)
    rows = [(c, rnd.choice([0.0, 1.5, 2.25, 1e9]) + rnd.randint(0, 5), 1) for c in "ab" for _ in range(80)]
    df = spark.createDataFrame(rows, "k string, t double, n int")
    got = {(r["k"], r["t"]): r["run_n"] for r in ordering.running(df, ["k"], "t", ["n"], True, 4, 2).collect()}
    for (k, t), run in got.items():
        assert run == sum(1 for r in rows if r[0] == k and r[1] >= t)


def test_stratified_folds(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(23)], "id long, label string")
    for r in ordering.stratified_folds(df, "label", "id", 4).groupBy("label", "fold").count().collect():
        n = 15 if r["label"] == "a" else 8
        assert r["count"] in (n // 4, -(-n // 4))


def test_auc_and_mean_roc(spark):
    rnd = random.Random(2)
    rows = [(f, float(rnd.randint(0, 12)), rnd.randint(0, 1)) for f in (0, 1, 2) for _ in range(60)]
    df = spark.createDataFrame(rows, "fold int, score double, hit int")
    got = {r["fold"]: r["auc"] for r in evaluate.auc(df, ["fold"]).collect()}
    curves = []
    for f in (0, 1, 2):
        pos = [s for g, s, h in rows if g == f and h]
        neg = [s for g, s, h in rows if g == f and not h]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert got[f] == pytest.approx(want)
        pts = [(0.0, 0.0)] + [(sum(n >= t for n in neg) / len(neg), sum(p >= t for p in pos) / len(pos))
                              for t in sorted({s for g, s, _ in rows if g == f}, reverse=True)]
        curves.append(np.interp(np.arange(100) / 99.0, *zip(*pts)))
        curves[-1][0] = 0.0
    mean = np.mean(curves, axis=0)
    mean[-1] = 1.0
    out = [r["tpr"] for r in evaluate.mean_roc(df, "fold").orderBy("g").collect()]
    assert np.allclose(out, mean)


def test_knn_is_exact(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.3, size=(60, 3)) for c in (0, 3, 9)])
    df = spark.createDataFrame([(i, [float(a) for a in r], int(i // 60)) for i, r in enumerate(x)], "id long, x array<double>, label int")
    q = df.where("id % 7 = 0").select(F.col("id").alias("qid"), "x")
    t = df.where("id % 7 <> 0").select(F.col("id").alias("tid"), "x", "label")
    got = defaultdict(set)
    for r in nearest.knn(q, t, 4).collect():
        got[r["qid"]].add(r["tid"])
    train = [i for i in range(180) if i % 7]
    for i in range(0, 180, 7):
        d = sorted((np.linalg.norm(x[i] - x[j]), j) for j in train)[:4]
        assert got[i] == {j for _, j in d}


def test_f_tail():
    assert select.f_tail(4.0, 1, 10) == pytest.approx(0.073388, abs=1e-6)      # t distribution, t = 2, 10 df
    assert select.f_tail(1.0, 5, 5) == pytest.approx(0.5)
    assert select.f_tail(19.0, 2, 2) == pytest.approx(0.05)                     # 1 / (1 + f) for 2, 2 df
    assert select.f_tail(0.0, 3, 9) == 1.0


def test_lasso_and_ridge(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 5))
    y = (x[:, 0] - 2 * x[:, 1] + 0.1 * rng.normal(size=120) > 0).astype(int)
    cols = [f"c{k}" for k in range(5)]
    df = spark.createDataFrame([(i, *map(float, r), int(t), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "case_id long, " + ", ".join(f"{c} double" for c in cols) + ", label long, y double")
    r = select.lasso_cv(df, cols, "y", "label", "case_id", n_alphas=30)
    xc, yc = x - x.mean(0), y - y.mean()
    g = xc.T @ (yc - xc @ r["coef"]) / 120  # optimality: |gradient| <= alpha, equal where the coefficient is not 0
    assert np.all(np.abs(g) <= r["alpha"] + 1e-5)
    on = r["coef"] != 0
    assert np.allclose(np.abs(g[on]), r["alpha"], atol=1e-5) and on[:2].all()
    assert np.abs(r["mse"]).max() < 1 and r["path"].shape == (100, 5)
    df = df.withColumn("t", F.col("y") * 2 - 1)
    a, coef = select.ridge_cv(df, cols, "t", "label", "case_id")
    want = np.linalg.solve(xc.T @ xc + a * np.eye(5), xc.T @ (2 * yc))
    assert np.allclose(coef, want)


def test_discriminants(spark):
    from voxelframe.operators import learn

    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal((0, 0), 0.5, (60, 2)), rng.normal((3, 3), 0.5, (60, 2))])
    df = spark.createDataFrame([(i, float(a), float(b), int(i >= 60)) for i, (a, b) in enumerate(x)], "case_id long, a double, b double, label long")
    for quad in (False, True):
        out = learn.discriminant(df, df, ["a", "b"], quadratic=quad)
        assert out.where("label <> predict").count() == 0
    assert learn.adaboost(df, df, ["a", "b"], rounds=3).where("label <> predict").count() <= 2


def test_correlations(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["r"] for r in tabular.correlations(df, ["a", "b", "c"]).collect()}
    want = np.corrcoef(x.T)
    for i, p in enumerate("abc"):
        for j, q in enumerate("abc"):
            assert got[(p, q)] == pytest.approx(want[i, j])


def test_full_extraction_of_one_case(spark):
    """Every class over a reduced grid; the number of columns follows from the variants."""
    rnd = random.Random(9)
    vox = spark.createDataFrame([(1, z, y, x, rnd.random(), 1) for z in range(3) for y in range(3) for x in range(3)]
                                + [(2, 0, 0, 0, 1.0, 1)], CELL)
    long = extract.segment(vox, extract.ALL_CLASSES, (2, 4), (1,))
    rows = long.collect()
    assert {r["case_id"] for r in rows} == {1}  # the one-cell case is skipped
    names = [r["feature"] for r in rows]
    assert len(names) == len(set(names))
    per = Counter(n.split("_")[0] for n in names)
    assert per["firstorder"] == 46  # 45 with the plain root mean square beside the norm
    assert per["glcm"] == 254 * 2
    assert per["glrlm"] == 16 * 2 and per["gldm"] == 14 * 2 and per["ngtdm"] == 5 * 2 and per["glszm"] == 16 * 2 and per["shape"] == 7 * (1 + 2 + 4)
