"""Cases in which results used to be changed or dropped silently."""

import math
import random

import pytest
from pyspark.sql import functions as F

from voxelframe.operators import components, grid, learn, nearest, ordering, tabular, texture
from voxelframe.sources import readers


def write(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_high_levels_keep_their_codes(spark):
    rows = [(0, 70_000 + k, 0, 0, k, 70_000 + k) for k in range(2)]
    lev = spark.createDataFrame(rows, "case_id int, bin_count int, z int, y int, x int, g int").withColumn("bin_count", F.lit(80_000))
    got = texture.glcm_of_levels(lev, (1,), symmetric=False).collect()
    assert [(r.dist, r.i, r.j, r.n) for r in got] == [(1, 70_000, 70_001, 1)] and 0 <= got[0].angle < 13
    far = texture.glcm_of_levels(lev.withColumn("x", F.col("x") * 19), (19,), symmetric=False, force2d=0).collect()
    assert [(r.dist, r.n) for r in far] == [(19, 1)]


def test_cells_out_of_range_raise(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1 << 20, 1), (0, 0, 0, -(1 << 20), 1)], "case_id int, z int, y int, x int, g int")
    with pytest.raises(Exception, match="outside the range"):
        cells.select(grid.cell_key().alias("k")).collect()


def test_scaler_knows_its_features(spark):
    long = spark.createDataFrame([(i, f, float(i)) for i in range(4) for f in "ab"], "case_id int, feature string, value double")
    stats = tabular.fit_zscore(long.where("feature = 'a'"))
    with pytest.raises(Exception, match="not fitted"):
        tabular.apply_zscore(long, stats).collect()
    with pytest.raises(ValueError, match="b \\(not fitted\\)"):
        tabular.check_fitted(long, stats)
    with pytest.raises(ValueError, match="b \\(missing\\)"):
        tabular.check_fitted(long.where("feature = 'a'"), tabular.fit_zscore(long))
    tabular.check_fitted(long, tabular.fit_zscore(long))


def test_lists_are_read_by_name(spark, tmp_path):
    r = readers.cases(spark, write(tmp_path, "c.csv", "mask,image\nm1,i1\n")).first()
    assert (r.image, r.mask) == ("i1", "m1")
    got = readers.batch_cases(spark, write(tmp_path, "b.csv", "ID,Mask,Image,Label\n7,m1,/a/i1,2\n8,m2,,1\n"), "/base").collect()
    assert [r.asDict() for r in got] == [{"Image": "/a/i1", "Mask": "/base/m1", "Label": 2, "Label_channel": None, "ID": "7"}]
    with pytest.raises(ValueError, match="no column Mask"):
        readers.batch_cases(spark, write(tmp_path, "n.csv", "ID,Image\n7,i\n"))
    f = readers.feature_table(spark, write(tmp_path, "f.csv", "note,f1,case_id\nx,0.5,3\n"), "case_id BIGINT, f1 DOUBLE").first()
    assert (f.case_id, f.f1, f.note) == (3, 0.5, "x")


def test_json_tables_of_any_layout(spark, tmp_path):
    doc = """{
  "columns": [{"name": "k", "group": "g", "type": "t", "intent": "i"}],
  "data": [["1"],
           ["2"]]
}"""
    got = readers.json_table(spark, write(tmp_path, "a.json", doc)).orderBy("row").collect()
    assert [(r.row, r.name, r.value) for r in got] == [(0, "k", "1"), (1, "k", "2")]
    lines = "\n".join(" ".join(doc.split()) for _ in range(2))
    assert readers.json_table(spark, write(tmp_path, "b.json", lines), lines=True).count() == 4
    with pytest.raises(Exception):
        readers.json_table(spark, write(tmp_path, "c.json", '{"columns": [')).collect()


def test_running_totals_of_heavy_tails(spark, monkeypatch):
    """Log-uniform values: parts stay small, totals exact."""
    rng = random.Random(1)
    rows = [(0, math.exp(rng.uniform(0, 40)), rng.randrange(1, 4)) for _ in range(6000)] + [(1, float(i % 7), 1) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, v double, w long")
    got = ordering.running(df, ["k"], "v", ["w"], fill=32).orderBy("k", "v").collect()
    want, total = {}, {}
    for k, v, w in sorted(rows):
        total[k] = total.get(k, 0) + w
        want[k, v] = total[k]
    assert {(r.k, r.v): r.run_w for r in got} == want and {r.k: r.tot_w for r in got} == total
    cuts = df.where("k = 0").agg(ordering._cuts("v").alias("c"))
    sizes = [r[0] for r in df.where("k = 0").crossJoin(F.broadcast(cuts)).groupBy(ordering._part("v", "c").alias("p")).count().select("count").collect()]
    assert max(sizes) <= 3 * 6000 / ordering.PARTS


def test_components_of_a_long_path(spark):
    n = 3000
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(0, a, b) for a, b in zip(order, order[1:], strict=False)], "k int, u long, w long")
    got = components.contract(edges)
    assert got.count() == n - 1 and got.select("w").distinct().collect()[0].w == 0


def test_nearest_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERIES", 7)
    monkeypatch.setattr(nearest, "TRAIN", 11)
    rng = random.Random(3)
    make = lambda n: [(i, [float(rng.randrange(3)) for _ in range(4)]) for i in range(n)]
    q, t = make(40), make(60)
    got = {(r.qid, r.rank): (r.tid, round(r.distance, 9)) for r in nearest.knn(
        spark.createDataFrame(q, "qid long, x array<double>"), spark.createDataFrame(t, "tid long, x array<double>"), 5).collect()}
    want = {}
    for i, x in q:
        near = sorted((round(math.dist(x, y), 9), j) for j, y in t)[:5]
        want.update({(i, k + 1): (j, d) for k, (d, j) in enumerate(near)})
    assert got == want


FAST = {"random": {"numTrees": 5, "maxDepth": 4}, "bagging": {"numTrees": 3, "maxDepth": 4}, "xgboost": {"maxIter": 3, "maxDepth": 2},
        "catboost": {"maxIter": 3, "maxDepth": 2}, "mlp": {"hidden": (8,), "maxIter": 40}, "adaboost": {"rounds": 6}, "svc": {"dims": 64},
        "nusvc": {"dims": 64}, "knn": {"n_neighbors": 5}}


@pytest.mark.parametrize("name", learn.MODELS)
def test_every_model_trains_and_scores(spark, name):
    rng = random.Random(4)
    rows = [(i, *[rng.gauss(3 * (i % 3 == k) - 1.5, 0.6) for k in range(3)], 5 + 2 * (i % 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "case_id long, a double, b double, c double, label long").cache()
    got = learn.train_score(name, df.where("case_id < 60"), df.where("case_id >= 60"), ["a", "b", "c"], **FAST.get(name, {})).collect()
    assert len(got) == 30 and {r.predict for r in got} <= {5, 7, 9}
    assert all(len(r.scores) == 3 and abs(sum(r.scores) - 1) < 1e-6 for r in got)
    assert sum(r.predict == r.label for r in got) >= 24


def stationary(v, low, axis_length):
    """One level on one axis with wrapped ends, by the definition the operator's taps follow."""
    from voxelframe.operators import filters

    n = axis_length
    return [[sum(w[k] * v[(i + o) % n] for o, w in filters.wavelet_taps(low)) for i in range(n)] for k in range(2)]


def test_wavelet_levels_of_an_odd_axis(spark):
    """The wrapped cell that makes the axis even stays until the last level."""
    from voxelframe.operators import filters

    v = [3.0, 1.0, 4.0, 1.5, 9.0]
    df = spark.createDataFrame([(0, 0, 0, x, a, 1) for x, a in enumerate(v)], "case_id int, z int, y int, x int, v double, m int")
    got = {}
    for r in filters.wavelet(df, axes=("x",), level=2).collect():
        got.setdefault(r.image_type, {})[r.x] = r.v
    padded = [*v, v[0]]
    low1, high1 = stationary(padded, filters.COIF1, 6)
    low2, high2 = stationary(low1, filters.COIF1, 6)
    want = {"wavelet-H": high1, "wavelet2-L": low2, "wavelet2-H": high2}
    assert set(got) == set(want)
    for name, values in want.items():
        assert [round(got[name][k], 9) for k in range(5)] == [round(x, 9) for x in values[:5]] and len(got[name]) == 5


def test_nearest_fills_missing_cells(spark):
    from voxelframe.operators import filters

    vox = spark.createDataFrame([(0, 0, 0, 0, 5.0, 1), (0, 0, 0, 2, 7.0, 1)], "case_id int, z int, y int, x int, v double, m int")
    geo = spark.createDataFrame([(0, 1, 1, 3, 1.0, 1.0, 1.0)], "case_id int, nz int, ny int, nx int, dz double, dy double, dx double")
    got = {r.x: (r.v, r.m) for r in filters.resample(vox, geo, (1.0, 1.0, 1.0), "nearest").collect()}
    assert got == {0: (5.0, 1), 1: (0.0, 0), 2: (7.0, 1)}


def test_composed_extraction(spark):
    """Normalising, resegmenting, image types, chosen names and provenance in one run."""
    import numpy as np

    from voxelframe.operators import extract

    rng = np.random.default_rng(5)
    v = rng.normal(10, 3, (4, 4, 4))
    m = rng.random((4, 4, 4)) < 0.7
    rows = [(1, z, y, x, float(v[z, y, x]), int(m[z, y, x])) for z in range(4) for y in range(4) for x in range(4)]
    df = spark.createDataFrame(rows, "case_id int, z int, y int, x int, v double, m int")
    s = extract.Settings(normalise=10.0, min_cells=5, resegment=(-8.0, None, "absolute"), image_types=("original", "square", "wavelet"),
                         classes=("firstorder",), names={"firstorder": ("Mean", "Minimum")}, plugins=False)
    got = {(r.image_type, r.feature): r.value for r in extract.compose(df, s).collect()}
    w = (v - v.mean()) / v.std(ddof=1) * 10
    keep = m & (w >= -8)
    assert abs(got["original", "firstorder_Mean"] - w[keep].mean()) < 1e-9
    square = (w / np.sqrt(np.abs(w).max())) ** 2
    assert abs(got["square", "firstorder_Mean"] - square[keep].mean()) < 1e-9
    assert got["diagnostics", "Mask_VoxelNum"] == keep.sum() and abs(got["diagnostics", "Image_Mean"] - w.mean()) < 1e-9
    assert len([k for k in got if k[0].startswith("wavelet-")]) == 16
    assert {f for t, f in got if t != "diagnostics"} == {"firstorder_Mean", "firstorder_Minimum"}
