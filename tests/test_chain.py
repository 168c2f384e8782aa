"""The selection chain on one set of sums against the filters run one by one on the rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import select

NAMES = [f"f{k}" for k in range(7)]


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 120)
    x = rng.normal(size=(120, 7)) + 100.0
    x[:, 1] += y * 2.0
    x[:, 2] -= (y == 1) * 3.0
    x[:, 6] = 4.0
    rows = [(i, int(c), *map(float, r)) for i, (c, r) in enumerate(zip(y, x))]
    rows[7] = (*rows[7][:3], None, *rows[7][4:])
    rows.append((999, None, *[1e9] * 7))
    return spark.createDataFrame(rows, "case_id long, label long, " + ", ".join(f"{n} double" for n in NAMES)).where("label is not null").cache()


@pytest.fixture(scope="module")
def prepared(wide):
    return select.prepare(wide, NAMES)


def test_variance_and_k_best_equal_the_chain_on_rows(wide, prepared):
    long = wide.unpivot(["case_id", "label"], NAMES, "feature", "value")
    filled = long.withColumn("value", F.coalesce("value", F.lit(float(wide.agg(F.avg("f1")).first()[0]))))
    m, left = select.chain(filled, [("variance", lambda x: select.variance_filter(x, 0.03)), ("k_best", lambda x: select.k_best(x, 2))])
    got, names = select.chain_on_sums(prepared, [("variance", {"threshold": 0.03}), ("k_best", {"k": 2})])
    want = {r["feature"]: (r["variance"], r["k_best"]) for r in m.collect()}
    assert {r["feature"]: (r["variance"], r["k_best"]) for r in got.collect()} == want
    assert set(names) == {f for f, k in want.items() if k[1]} == {"f1", "f2"}


def test_ridge_and_lasso_equal_fits_on_the_rows(spark, prepared):
    rows, s = prepared
    on = [0, 1, 2, 4]
    names = [NAMES[i] for i in on]
    data = rows.toPandas()
    assert data[NAMES].to_numpy().min() == 0.0 and data[NAMES].to_numpy().max() == 1.0 and (data["f6"] == 0).all()
    x = data[names].to_numpy() - data[names].to_numpy().mean(0)
    targets = [s.with_target(on, [1.0 if c == t else -1.0 for c in range(3)]) for t in range(3)]
    a, coef = select.ridge_from(targets)
    for t in range(3):
        y = np.where(data["label"] == t, 1.0, -1.0)
        assert np.allclose(coef[t], np.linalg.solve(x.T @ x + a * np.eye(4), x.T @ (y - y.mean())), atol=1e-9)
    whole = select.lasso_cv(rows.drop("fold", "part").withColumn("y", F.col("label") * 1.0), names, "y", "label", "case_id")
    mine = select.lasso_from(spark, s.with_target(on, [0.0, 1.0, 2.0]))
    assert mine["alpha"] == pytest.approx(whole["alpha"]) and np.allclose(mine["coef"], whole["coef"], atol=1e-6)


def test_any_order_and_all_six(prepared):
    for order in itertools.permutations([("variance", {"threshold": 0.0}), ("k_best", {"k": 3}), ("ridge", {})]):
        m, names = select.chain_on_sums(prepared, list(order))
        rows = [tuple(r[n] for n, _ in order) for r in m.collect()]
        assert all(a >= b >= c for a, b, c in rows) and {"f1", "f2"} <= set(names)
    six = [("variance", {}), ("k_best", {"k": 5}), ("ridge", {}), ("lasso", {"n_alphas": 20}), ("l1_logistic", {"grid": (0.01,)}), ("tree", {})]
    m, names = select.chain_on_sums(prepared, six)
    assert m.columns == ["feature", *select.STEPS[:2], "ridge", "lasso", "l1_logistic", "tree"] and "f1" in names
    none, names = select.chain_on_sums(prepared, [("k_best", {"k": 0}), ("variance", {})])
    assert names == [] and {tuple(r) for r in none.collect()} == {(n, 0, 0) for n in NAMES}
    with pytest.raises(ValueError, match="no filter pca"):
        select.chain_on_sums(prepared, [("pca", {})])
