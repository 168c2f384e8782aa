"""Hyper-parameter search against separate fits, brute force and finite differences."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import ordering, search, select

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(7)
    y = np.arange(90) % 3
    x = rng.normal(size=(90, 3)) + np.eye(3)[y] * 1.2
    return x, y


@pytest.fixture(scope="module")
def table(spark, points):
    x, y = points
    return spark.createDataFrame([(i, *map(float, r), int(c) * 10) for i, (r, c) in enumerate(zip(x, y))],
                                 "case_id long, a double, b double, c double, label long")


@pytest.fixture(scope="module")
def folds(spark, table):
    got = {r["case_id"]: r["fold"] for r in ordering.stratified_folds(table, "label", "case_id", 3).collect()}
    return np.array([got[i] for i in range(90)])


def accuracies(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["model"], r["params"]), {})[r["fold"]] = r["accuracy"]
    return out


def test_candidates():
    assert {m: len(search.candidates(m, 10)) for m in search.MODELS} == {
        "svc": 200, "nusvc": 96, "knn": 240, "logistic": 80, "decision": 200, "random": 50, "mlp": 18}
    assert search.candidates("svc", 10) == search.candidates("svc", 10) != search.candidates("svc", 10, seed=1)
    with pytest.raises(ValueError, match="no search for sgd"):
        search.grid("sgd", 2)


def test_penalised_logistic_equals_separate_fits(spark, table, folds):
    """Weights of the shared passes against Spark's own solver, fold by fold."""
    from pyspark.ml.classification import LogisticRegression

    rows = spark.createDataFrame([(r["case_id"], [r["a"], r["b"], r["c"]], r["label"] // 10, int(folds[r["case_id"]]))
                                  for r in table.collect()], "id long, x array<double>, y int, fold int").repartition(3)
    size = np.bincount(folds, minlength=3).astype(float)
    jobs = [("logistic", "softmax", 0.0, p, c) for p in ("l1", "l2") for c in (0.1, 2.0)]
    groups = search.fit_jobs(rows, jobs, 3, size, 3, 3, rounds=500, tol=1e-9)
    data = select.assemble(table.withColumn("y", F.col("label") / 10.0), FEATURES)
    marks = spark.createDataFrame([(i, int(f)) for i, f in enumerate(folds)], "case_id long, fold int")
    data = data.join(marks, "case_id").cache()
    g = groups[0]
    for k in (0, 4, 7, 11):
        (_, _, _, penalty, c), f = g.keys[k], int(g.folds[k])
        m = LogisticRegression(labelCol="y", family="multinomial", regParam=1.0 / c / (90 - size[f]), tol=1e-12, maxIter=1000,
                               elasticNetParam=float(penalty == "l1"), standardization=False).fit(data.where(F.col("fold") != f))
        assert np.allclose(g.weights[0][k][1:].T, m.coefficientMatrix.toArray(), atol=2e-3)


def test_network_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    x, y = np.hstack([np.ones((5, 1)), rng.normal(size=(5, 3))]), np.eye(3)[rng.integers(0, 3, 5)]
    use = np.array([[1, 1, 0, 1, 1.0]])
    w = [rng.normal(size=(1, 4, 6)), rng.normal(size=(1, 6, 3)), rng.normal(size=(1, 3))]

    def loss(loss_name):
        z = search.scores(loss_name, x, w)[0][0]
        return -(use[0] * ((z - np.log(np.exp(z).sum(1, keepdims=True))) * y).sum(1)).sum()

    for name in ("tanh", "relu"):
        d = search.gradients(name, x, y, use, w)
        for i, at in ((0, (0, 2, 3)), (1, (0, 4, 1)), (2, (0, 2))):
            old = w[i][at]
            w[i][at] = old + 1e-6
            up = loss(name)
            w[i][at] = old - 1e-6
            down = loss(name)
            w[i][at] = old
            assert abs((up - down) / 2e-6 - d[i][at]) < 1e-5


def test_neighbours_equal_brute_force(table, points, folds):
    x, y = points
    tried = {"knn": [{"n_neighbors": k, "weights": w, "algorithm": "brute", "leaf_size": 1} for k in (1, 5, 8) for w in ("uniform", "distance")]}
    got = accuracies(search.search(["knn"], table, FEATURES, tried=tried))
    assert len(got) == 6
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for (_, params), acc in got.items():
        p = json.loads(params)
        for f in range(3):
            right = 0
            for i in np.flatnonzero(folds == f):
                near = sorted((d[i, j], j) for j in np.flatnonzero(folds != f))[:p["n_neighbors"]]
                v = np.zeros(3)
                for far, j in near:
                    v[y[j]] += 1.0 if p["weights"] == "uniform" else 1.0 / far
                right += int(v.argmax() == y[i])
            assert acc[f] == pytest.approx(right / (folds == f).sum())


def test_every_model_learns_and_marks_its_best(spark, table):
    easy = table.withColumn("a", F.col("label") * 1.0 / 5 - 2.0).withColumn("b", F.abs("a") * 2)
    tried = {"svc": [{"kernel": "rbf", "gamma": "auto", "C": 100.0, "decision_function_shape": s, "shrinking": True} for s in ("ovo", "ovr")],
             "nusvc": [{"kernel": "linear", "gamma": "auto", "nu": 0.4, "decision_function_shape": "ovr", "shrinking": True}],
             "decision": [{"max_features": "sqrt", "max_depth": None, "min_samples_split": 2, "min_samples_leaf": n} for n in (1, 50)],
             "random": [{"n_estimators": 20, "max_features": "sqrt", "max_depth": 10, "min_samples_split": 2, "min_samples_leaf": 1, "bootstrap": True}],
             "mlp": [{"alpha": 0.001, "activation": "tanh", "solver": "adam", "learning_rate": "adaptive"}]}
    rows = search.search(list(tried), easy, FEATURES, tried=tried, rounds=150).collect()
    assert {r["model"] for r in rows} == set(tried) and len(rows) == 3 * 7
    best = {r["model"]: (r["candidate"], r["mean_accuracy"]) for r in rows if r["best"]}
    assert len(best) == 5 and all(c == 0 for c, _ in best.values())
    assert all(a > 0.9 for _, a in best.values()), best
