"""Zone features, feature maps of any radius and multi-class boosting against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import boosting, emphasis, evaluate, extract, grid, learn, texture, weighted, windows
from voxelframe.operators import cooccurrence as co

CELL = "case_id long, z int, y int, x int, v double, m int"


# ---- zones --------------------------------------------------------------------------------------

def flood(levels):
    """(level, size) of every 26-neighbour zone of equal level."""
    left, out = set(levels), []
    while left:
        todo, size = [left.pop()], 0
        g = levels[todo[0]]
        while todo:
            z, y, x = todo.pop()
            size += 1
            for d in itertools.product((-1, 0, 1), repeat=3):
                n = (z + d[0], y + d[1], x + d[2])
                if n in left and levels[n] == g:
                    left.remove(n)
                    todo.append(n)
        out.append((g, size))
    return out


def zone_features(zones):
    n = len(zones)
    i, j = (np.array(c, float) for c in zip(*zones))
    share = lambda c: np.array([np.sum(c == v) for v in np.unique(c)])
    cells = np.array([zones.count(z) for z in sorted(set(zones))]) / n
    var = lambda c: np.mean((c - c.mean()) ** 2)
    return {"SmallAreaEmphasis": np.mean(1 / j ** 2), "LargeAreaEmphasis": np.mean(j ** 2), "GrayLevelNonUniformity": np.sum(share(i) ** 2) / n,
            "GrayLevelNonUniformityNormalized": np.sum(share(i) ** 2) / n ** 2, "SizeZoneNonUniformity": np.sum(share(j) ** 2) / n,
            "SizeZoneNonUniformityNormalized": np.sum(share(j) ** 2) / n ** 2, "ZonePercentage": n / j.sum(), "GrayLevelVariance": var(i), "ZoneVariance": var(j),
            "ZoneEntropy": -np.sum(cells * np.log2(cells)), "LowGrayLevelZoneEmphasis": np.mean(1 / i ** 2), "HighGrayLevelZoneEmphasis": np.mean(i ** 2),
            "SmallAreaLowGrayLevelEmphasis": np.mean(1 / (i * j) ** 2), "SmallAreaHighGrayLevelEmphasis": np.mean(i ** 2 / j ** 2),
            "LargeAreaLowGrayLevelEmphasis": np.mean(j ** 2 / i ** 2), "LargeAreaHighGrayLevelEmphasis": np.mean(i ** 2 * j ** 2)}


def test_zone_features_of_images(spark):
    """Cases and image types share one contraction; each equals a flood fill of its own volume."""
    rng = np.random.default_rng(3)
    rows, volumes = [], {}
    for case in range(3):
        v, m = rng.integers(0, 12, (4, 5, 3)).astype(float), rng.random((4, 5, 3)) < 0.8
        v[0, 0, 0], v[3, 4, 2], m[0, 0, 0], m[3, 4, 2] = 0.0, 12.0, True, True
        volumes[case] = v, m
        rows += [(case, *map(int, p), float(v[p]), int(m[p])) for p in np.ndindex(4, 5, 3)]
    vox = spark.createDataFrame(rows, CELL)
    images = extract.image_types(vox, ("original", "exponential"))
    got = {(r.case_id.case_id, r.case_id.image_type, r.feature): r.value for r in extract.zones(grid.roi(images), (2, 4)).collect()}
    assert len(got) == 3 * 2 * 2 * 16
    for case, (v, m) in volumes.items():
        top = np.abs(v).max()
        for kind, image in (("original", v), ("exponential", np.exp(v * np.log(top) / top))):
            inside = image[m]
            for bins in (2, 4):
                edges = inside.min() + (inside.max() - inside.min()) / bins * np.arange(bins)
                levels = {p: int(np.sum(edges <= image[p])) for p in np.ndindex(*v.shape) if m[p]}
                for name, want in zone_features(flood(levels)).items():
                    assert got[case, kind, f"glszm_{name}_b_{bins}"] == pytest.approx(want, abs=1e-9), (case, kind, bins, name)
    assert set(emphasis.zone()) == set(emphasis.ZONE) and len(emphasis.ZONE) == 16


# ---- feature maps -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def volume(spark):
    rng = np.random.default_rng(8)
    rows = [(case, z, y, x, float(rng.integers(-3, 9)), int(rng.random() < 0.7)) for case in (1, 2) for z in range(4) for y in range(3) for x in range(4)]
    rows += [(3, 0, 0, 0, 2.5, 1), (3, 0, 0, 9, 4.0, 0)]  # one region cell
    return spark.createDataFrame(rows, CELL).cache()


def as_map(rows, keys=("z", "y", "x")):
    return {(r["case_id"], *[r[k] for k in keys]): r for r in rows}


@pytest.mark.parametrize("radius", [1, 2])
def test_first_order_maps(spark, volume, radius):
    """Every statistic of every centre equals that of its neighbourhood taken as a case of its own."""
    cells = grid.roi(volume)
    near = extract.kernels(cells, radius)
    blk = weighted.block(weighted.collapse(near, ["case_id"]), ["case_id"])
    want = {tuple(r["case_id"]): r for r in blk.collect()}
    got = as_map(windows.moments(cells, radius).join(windows.order_statistics(windows.gathered(cells, radius)), ["case_id", "z", "y", "x"]).collect())
    assert set(got) == set(want) and len(got) == cells.count()
    names = [c for c in blk.columns if c != "case_id"]
    assert set(names) == {*windows.MOMENT_NAMES, *windows.ORDER_NAMES}
    for k, w in want.items():
        for n in names:
            assert got[k][n] == pytest.approx(w[n], rel=1e-7, abs=1e-7), (k, n)


@pytest.mark.parametrize("radius, distances", [(1, (1,)), (1, (1, 2)), (2, (1, 3))])
def test_pair_counts_of_neighbourhoods(spark, volume, radius, distances):
    levels = grid.discretise(grid.roi(volume), 4).withColumn("bin_count", F.lit(4)).cache()
    near = extract.kernels(levels, radius, ("g",)).withColumn("bin_count", F.lit(4))
    count = lambda df: sorted((tuple(r["case_id"]), r["dist"], r["angle"], r["i"], r["j"], r["n"]) for r in df.collect())
    want = count(texture.glcm_of_levels(near, distances))
    assert want and count(windows.pair_counts(levels, radius, distances)) == want
    facts = {tuple(r["case_id"]): r for r in windows.level_facts(levels, radius).collect()}
    for c, *z in near.select("case_id", "g").distinct().groupBy("case_id").agg(F.sort_array(F.collect_list("g")).alias("g")).collect():
        assert facts[tuple(c)]["levels"] == z[0] and facts[tuple(c)]["ng"] == max(z[0])


def test_voxel_map_of_named_features(spark, volume):
    names = {"firstorder": ("Mean", "Median"), "glcm": ("Contrast", "Correlation", "Imc2", "Cluster")}
    got = extract.voxel_map(volume, 4, 1, -1.0, names).collect()
    every = {r["feature"] for r in got}
    assert {"firstorder_Mean", "firstorder_Median", "glcm_Contrast_d_1_f_origin", "glcm_Imc2_d_1"} <= every
    assert len(got) == volume.count() * len(every)
    outside = {tuple(r)[:4] for r in volume.where("m = 0").select("case_id", "z", "y", "x").collect()}
    assert all(r["value"] == -1.0 for r in got if tuple(r)[:4] in outside)
    levels = grid.discretise(grid.roi(volume), 4).withColumn("bin_count", F.lit(4))
    near = extract.kernels(levels, 1, ("g",)).withColumn("bin_count", F.lit(4))
    p = texture.normalise(texture.glcm_of_levels(near))
    want = {(*tuple(r["case_id"]), f"glcm_{r['feature']}_d_1" + ("" if r["variant"] == "value" else f"_{r['variant']}")): r["value"]
            for r in co.features(p, windows.level_facts(levels, 1), names["glcm"]).collect()}
    have = {(*tuple(r)[:4], r["feature"]): r["value"] for r in got}
    assert len(want) > 1000
    for k, v in want.items():
        if v is not None and not math.isnan(v):
            assert have[k] == pytest.approx(v, rel=1e-9, abs=1e-9)


def test_maps_of_two_cells(spark):
    """Two different values have none between their deciles: no value, not an error, and the case keeps the others. Reciprocals may cancel."""
    place = ["case_id", "z", "y", "x"]
    vox = spark.createDataFrame([(1, 0, 0, 0, -2.0, 1), (1, 0, 0, 1, 2.0, 1), (1, 0, 0, 2, 9.0, 0)], CELL)
    cells = grid.roi(vox)
    maps = windows.moments(cells, 1).join(windows.order_statistics(windows.gathered(cells, 1)), place).collect()
    case = weighted.block(weighted.collapse(cells, ["case_id"]), ["case_id"]).collect()
    assert len(maps) == 2 and len(case) == 1
    for r in (*maps, *case):
        assert r["RobustMeanAbsoluteDeviation"] is None and r["HarmonicMean"] == math.inf
        for name, want in {"Mean": 0, "Median": 0, "Deciles_p_10": -1.6, "TrimmedMean_p_0.25": 0, "MeanAbsoluteDeviationMean": 2, "Uniformity": 0.5}.items():
            assert r[name] == pytest.approx(want, abs=1e-12), name
    names = {"firstorder": ("RobustMeanAbsoluteDeviation", "MedianAbsoluteDeviationFromMean")}
    got = {(r.x, r.feature[11:]): r.value for r in extract.voxel_map(vox, 4, 1, -1.0, names).collect()}
    assert got == {(x, n): 2.0 if x < 2 and n.startswith("Median") else -1.0 for x in range(3) for n in names["firstorder"]}


def test_voxel_map_of_every_feature(spark):
    """A region of two cells, one of a lone cell and one of none: all features of all cells, by hand where there is a value."""
    vox = spark.createDataFrame([(1, 0, 0, 0, 1.0, 1), (1, 0, 0, 1, 3.0, 1), (2, 0, 0, 0, 5.0, 1), (3, 0, 0, 0, 7.0, 0)], CELL)
    rows = extract.voxel_map(vox, 8, 1, -1.0).collect()
    got = {(r.case_id, r.x, r.feature): r.value for r in rows}
    assert len(rows) == len(got) == 4 * 257 and None not in got.values()
    one = {"firstorder_Mean": 2, "firstorder_HarmonicMean": 1.5, "firstorder_RobustMeanAbsoluteDeviation": -1, "glcm_Contrast_d_1_f_origin": 49,
           "glcm_Average_d_1_f_origin": 4.5, "glcm_Dissimilarity_d_1_f_origin": 7, "glcm_Correlation_d_1_f_origin": -1, "glcm_SumAverage_d_1_inv_0": 9}
    for n, want in one.items():
        assert got[1, 0, n] == pytest.approx(want) and got[1, 1, n] == pytest.approx(want), n
    assert got[2, 0, "firstorder_Mean"] == 5 and got[2, 0, "firstorder_RobustMeanAbsoluteDeviation"] == 0
    assert all(v == -1 for (case, _, n), v in got.items() if case == 3 or case == 2 and n.startswith("glcm_"))
    alone = extract.voxel_map(vox.where("case_id > 1"), 8, 1, -1.0, {"glcm": ("Variance", "SumVariance", "Imc1", "Contrast")}).collect()
    assert len(alone) == 2 * 9 and {r.value for r in alone} == {-1.0}


def test_voxel_map_of_two_distances(spark):
    """Three cells in a row: only the middle one's cube holds a pair at distance 2."""
    vox = spark.createDataFrame([(1, 0, 0, x, float(x), 1) for x in range(3)] + [(None, 0, 0, 0, 1.0, 1)], CELL)
    rows = extract.voxel_map(vox, 3, 1, -1.0, {"glcm": ("Contrast",)}, (1, 2)).collect()
    got = {(r.case_id, r.x, r.feature): r.value for r in rows if r.feature.endswith("_f_origin")}
    assert len(rows) == 4 * 6 and len(got) == 4 * 2
    assert [got[1, x, "glcm_Contrast_d_1_f_origin"] for x in range(3)] == [1, 1, 1]
    assert [got[1, x, "glcm_Contrast_d_2_f_origin"] for x in range(3)] == [-1, 4, -1]
    assert {v for (case, *_), v in got.items() if case is None} == {-1.0}


def test_named_variants_are_those_made(grid_levels):
    lev = grid_levels([[1, 2, 3], [2, 2, 4]])
    p = texture.normalise(texture.glcm_of_levels(lev))
    made = co.features(p, windows.level_facts(lev, 1).groupBy("bin_count").agg(
        F.lit(0).cast("long").alias("case_id"), *[F.first(c).alias(c) for c in ("levels", "ng_present", "ng", "lv_avg", "lv_sd")]))
    assert {(r.feature, r.variant) for r in made.collect()} == set(co.variants())


def test_inverse_weights_below_the_smallest_double(spark):
    """Levels 31 and 32 only: the ranks 1 and 2 lie 60 spreads off the mean level."""
    vox = spark.createDataFrame([(1, 0, 0, x, v, 1) for x, v in ((0, 0.0), (5, 30.5), (6, 32.0))], CELL)
    got = {(r.x, r.feature): r.value for r in extract.voxel_map(vox, 32, 1, -1.0, {"glcm": ("Gaussian",)}).collect()}
    for x in (5, 6):
        assert got[x, "glcm_Gaussian_d_1_f_origin_nd_0_inv_1"] == math.inf and got[x, "glcm_Gaussian_d_1_f_origin_nd_0_inv_0"] == 0


# ---- boosting -----------------------------------------------------------------------------------

def data(spark, n=150, classes=3, seed=2):
    rng = random.Random(seed)
    rows = [(i, *[rng.randrange(8) / 2 for _ in range(3)], 0) for i in range(n)]
    rows = [(*r[:4], int(r[1] > 1.6) + int(r[1] > 1.6 and r[3] > 2.2) if classes == 3 else int(r[1] > 1.6)) for r in rows]
    return rows, spark.createDataFrame(rows, "case_id long, a double, b double, c double, label int")


def brute_split(x, g, h, s):
    """Every threshold of every feature."""
    best = None
    part = lambda a, b: a * a / (b + s.l2)
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= t
            gl, hl, gr, hr = g[low].sum(), h[low].sum(), g[~low].sum(), h[~low].sum()
            gain = round((part(gl, hl) + part(gr, hr) - part(g.sum(), h.sum())) / 2, 9)
            if hl >= s.min_weight and hr >= s.min_weight and gain > 1e-6 and (best is None or gain > best[0]):
                best = gain, f, t
    return best


def test_splits_are_the_best(spark):
    """Two levels of every class's first tree by trying all splits."""
    rows, df = data(spark)
    s = boosting.Settings(rounds=1, depth=2, bins=16)
    model = boosting.fit(df, ["a", "b", "c"], "label", 3, s)
    x, y = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    g, h = boosting.derivatives(np.zeros((len(x), 3)), y)
    for k, tree in enumerate(model.trees[0]):
        nodes = [(0, np.ones(len(x), bool))]
        while nodes:
            n, on = nodes.pop()
            want = brute_split(x[on], g[on, k], h[on, k], s)
            assert tree.value[n] == pytest.approx(-s.rate * g[on, k].sum() / (h[on, k].sum() + s.l2))
            if tree.feature[n] < 0:
                assert want is None or on.sum() < len(x)  # a leaf: nothing gains, or the depth is reached
                continue
            assert (tree.gain[n], tree.feature[n]) == pytest.approx(want[:2])
            at = model.edges[tree.feature[n]][tree.cut[n]]
            assert np.array_equal(x[on][:, want[1]] <= at, x[on][:, want[1]] <= want[2])
            low = x[:, tree.feature[n]] <= at
            nodes += [(tree.left[n], on & low), (tree.right[n], on & ~low)]


def test_boosting_learns_all_classes(spark):
    rows, df = data(spark, 300)
    model = boosting.fit(df.where("case_id < 200"), ["a", "b", "c"], "label", 3, boosting.Settings(rounds=15, depth=3))
    assert 10 < len(model.trees) <= 15  # past one checkpoint of the scores
    got = boosting.scored(model, df.where("case_id >= 200")).collect()
    assert sum(int(np.argmax(r.scores)) == r.label for r in got) >= 97 and all(abs(sum(r.scores) - 1) < 1e-9 for r in got)
    table = model.table(spark)
    imp = {r.feature: r.importance for r in boosting.importance(table, ["a", "b", "c"]).collect()}
    assert sum(imp.values()) == pytest.approx(1) and imp["a"] > imp["b"] and imp["c"] > imp["b"]
    # scores kept in the rows between rounds are those of the trees
    by_table = model.raw(np.array([r[1:4] for r in rows[200:]]))
    e = np.exp(by_table - by_table.max(1, keepdims=True))
    assert np.allclose(sorted(r.scores[0] for r in got), sorted((e / e.sum(1, keepdims=True))[:, 0]))


def test_boosting_odd(spark):
    rows, df = data(spark, 60, 2)
    gaps = df.withColumn("b", F.lit(None).cast("double")).withColumn("c", F.when(F.col("case_id") % 3 > 0, F.col("c")))
    model = boosting.fit(gaps, ["a", "b", "c"], "label", 2, boosting.Settings(rounds=4, depth=2))
    got = boosting.scored(model, gaps).collect()
    assert sum(int(np.argmax(r.scores)) == r.label for r in got) >= 55
    same = boosting.fit(df.withColumn("label", F.lit(0)), ["b"], "label", 1, boosting.Settings(rounds=5))
    assert len(same.trees) <= 5
    with pytest.raises(ValueError):
        boosting.cut_points(df, ["a"], 300)


# ---- one score table ------------------------------------------------------------------------------

def test_score_table_of_models(spark):
    rng = random.Random(1)
    rows = [(i, *[rng.gauss(3 * (i % 3 == k) - 1.5, 0.6) for k in range(3)], 5 + 2 * (i % 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "case_id long, a double, b double, c double, label long")
    table = learn.score_table(["bayesgaussian", "lineardiscriminant"], df, ["a", "b", "c"], 3)
    assert table.groupBy("model", "fold", "part").count().where("count = 30 OR count = 60").count() == 12
    acc = {(r.model, r.fold): r.accuracy for r in evaluate.accuracy(table.where("part = 'valid'"), ["model", "fold"]).collect()}
    assert len(acc) == 6 and min(acc.values()) > 0.8
    # all folds at once give what a fit of each fold gives
    from voxelframe.operators import ordering
    folds = ordering.stratified_folds(df, "label", "case_id", 3).cache()
    for kind in ("bayesgaussian", "bayesbernoulli"):
        got = {(r.fold, r.case_id): r for r in learn.cross_scores(kind, df, ["a", "b", "c"], 3).collect()}
        for r in learn.train_score(kind, folds.where("fold <> 1"), folds, ["a", "b", "c"], classes=[5, 7, 9]).collect():
            assert got[1, r.case_id].scores == pytest.approx(r.scores, abs=1e-9) and got[1, r.case_id].predict == r.predict
