"""Hyper-parameter search: every candidate of a model on stratified folds, with passes over the rows shared by all of them.

The job table is candidate x fold. Candidates that differ only in settings without an effect on predictions here are one fit.

* ``logistic``, ``svc``, ``nusvc`` and ``mlp`` are fitted by gradients. All jobs of all these models take one step in one
  pass over the staged fold table: a task adds up the gradients of every job over its rows in blocks, Spark adds the tasks.
  Linear ones take accelerated proximal steps whose length comes from the largest eigenvalue of the training rows' Gram
  matrix; networks take Adam steps. A job whose step falls below the tolerance leaves the passes.
* ``knn``: one join per fold with the largest k serves every k and both weights.
* ``decision``, ``random``: Spark ML fits, some at a time, on the one cached table.

Values should be on one scale (z-scores). Margins are squared hinges, one class against the rest; a radial kernel is a map
of random Fourier features. Intercepts are not penalised.
"""

from __future__ import annotations

import itertools
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.operators import nearest, ordering, tabular
from voxelframe.session import stage

MODELS = ("svc", "nusvc", "knn", "logistic", "decision", "random", "mlp")
LINEAR = ("svc", "nusvc", "logistic")
DIMS, HIDDEN, ROWS = 256, 100, 256   # random features of a radial kernel, hidden units, rows of a block
SEED = 42


def grid(model: str, classes: int) -> list[dict]:
    """All settings that may be tried for a model."""
    strengths = [float(c) for c in np.logspace(-4, 4, 20)]
    margin = {"kernel": ("linear", "rbf"), "gamma": (1.0, 2.0, 3.0, "auto"), "decision_function_shape": ("ovo", "ovr"),
              "shrinking": (True, False)}
    # fixed values: the settings searched per model
    spaces = {
        "svc": [{**margin, "C": strengths}],
        "nusvc": [{**margin, "nu": (0.4, 0.5, 0.6)}],
        "knn": [{"n_neighbors": tuple(range(classes, 4 * classes))[1::2], "weights": ("uniform", "distance"),
                 "algorithm": ("auto", "ball_tree", "kd_tree", "brute"), "leaf_size": (1, 2)}],
        "logistic": [{"penalty": ("l1", "l2"), "C": strengths, "solver": ("liblinear",), "multi_class": ("ovr",)},
                     {"penalty": ("l2",), "C": strengths, "solver": ("lbfgs",), "multi_class": ("ovr", "multinomial")}],
        "decision": [{"max_features": ("auto", "sqrt"), "max_depth": (*range(20, 201, 20), None), "min_samples_split": (2, 5, 10),
                      "min_samples_leaf": (1, 5, 10, 20, 50, 100)}],
        "random": [{"n_estimators": tuple(int(n) for n in np.linspace(200, 1000, 10)), "max_features": ("auto", "sqrt"),
                    "max_depth": (*range(10, 111, 10), None), "min_samples_split": (2, 5, 10), "min_samples_leaf": (10, 20, 50, 100),
                    "bootstrap": (True, False)}],
        "mlp": [{"alpha": tuple(10.0 ** -k for k in range(1, 10)), "activation": ("tanh", "relu"), "solver": ("adam",),
                 "learning_rate": ("adaptive",)}],
    }
    if model not in spaces:
        raise ValueError(f"no search for {model}; known are {', '.join(MODELS)}")
    return [dict(zip(s, v)) for s in spaces[model] for v in itertools.product(*s.values())]


# fixed values: how many settings are drawn where the grid is not tried whole
DRAWN = {"svc": 200, "nusvc": 200, "decision": 200, "random": 50}


def candidates(model: str, classes: int, seed: int = SEED) -> list[dict]:
    """The grid, or as many of its settings as are drawn for the model, without repeats, the same for a seed."""
    every = grid(model, classes)
    n = DRAWN.get(model, len(every))
    if n >= len(every):
        return every
    return [every[i] for i in sorted(np.random.default_rng(seed).choice(len(every), n, replace=False))]


def effective(model: str, c: dict, features: int) -> tuple:
    """What of a candidate changes the fit; equal results are fitted once.

    Trees: depths beyond 30 are 30, and a node of fewer than s rows is not split where each side keeps half of s.
    """
    if model in ("svc", "nusvc"):
        gamma = 0.0 if c["kernel"] == "linear" else 1.0 / features if c["gamma"] == "auto" else float(c["gamma"])
        return (model, "hinge", gamma, "l2", c["C"] if model == "svc" else c["nu"])
    if model == "logistic":
        return (model, "softmax" if c["multi_class"] == "multinomial" else "ovr", 0.0, c["penalty"], c["C"])
    if model == "mlp":
        return (model, c["activation"], c["alpha"])
    if model == "knn":
        return (model, c["n_neighbors"], c["weights"])
    depth = min(30, c["max_depth"] or 30)
    least = max(c["min_samples_leaf"], -(-c["min_samples_split"] // 2))
    if model == "decision":
        return (model, 1, depth, least, False)
    return (model, c["n_estimators"], depth, least, c["bootstrap"])


# ---- fits by gradients ---------------------------------------------------------------------------------

@dataclass
class Group:
    """Jobs of one loss over one map of the rows, their weights stacked."""

    loss: str
    gamma: float
    keys: list                       # effective settings of the jobs
    folds: np.ndarray                # the fold a job holds out
    l1: np.ndarray
    l2: np.ndarray
    weights: list                    # arrays [job, ..]
    state: dict = field(default_factory=dict)

    def subset(self, on: np.ndarray) -> tuple:
        return self.loss, self.gamma, self.folds[on], [w[on] for w in self.weights]


def mapped(x: np.ndarray, gamma: float) -> np.ndarray:
    """Rows with a leading one; random Fourier features of a radial kernel where gamma is set."""
    if gamma:
        rng = np.random.default_rng(SEED)
        w = rng.normal(scale=math.sqrt(2 * gamma), size=(x.shape[1], DIMS))
        x = np.cos(x @ w + rng.uniform(0, 2 * math.pi, DIMS)) * math.sqrt(2.0 / DIMS)
    return np.hstack([np.ones((len(x), 1)), x])


def scores(loss: str, x: np.ndarray, weights: list) -> tuple[np.ndarray, np.ndarray | None]:
    """([job, row, class], hidden layer)."""
    if loss in ("tanh", "relu"):
        h = np.matmul(x[None], weights[0])
        h = np.tanh(h) if loss == "tanh" else np.maximum(h, 0.0)
        return np.matmul(h, weights[1]) + weights[2][:, None, :], h
    return np.matmul(x[None], weights[0]), None


def gradients(loss: str, x: np.ndarray, y: np.ndarray, use: np.ndarray, weights: list) -> list:
    """Sums over the rows used by each job: use is [job, row]."""
    z, h = scores(loss, x, weights)
    if loss == "hinge":
        s = 2.0 * y - 1.0
        r = -2.0 * s * np.maximum(0.0, 1.0 - s * z)
    elif loss == "ovr":
        r = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) - y
    else:
        e = np.exp(z - z.max(2, keepdims=True))
        r = e / e.sum(2, keepdims=True) - y
    r = r * use[:, :, None]
    if h is None:
        return [np.matmul(x.T[None], r)]
    back = np.matmul(r, weights[1].transpose(0, 2, 1)) * ((1.0 - h * h) if loss == "tanh" else (h > 0))
    return [np.matmul(x.T[None], back), np.matmul(h.transpose(0, 2, 1), r), r.sum(1)]


def _blocks(batches, classes: int):
    """(x, one-hot labels, folds) of at most ROWS rows."""
    for b in batches:
        x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        y, f = b.column("y").to_numpy(), b.column("fold").to_numpy()
        for at in range(0, len(x), ROWS):
            s = slice(at, at + ROWS)
            yield x[s], np.eye(classes)[y[s]], f[s]


def _totals(rows: DataFrame, partial, tasks: int) -> dict[int, np.ndarray]:
    """Sum over all tasks of the vectors that `partial(batches)` gives by number.

    Spark adds the vectors of many tasks up to 64 per number at most, the driver adds those.
    """
    def vectors(batches):
        for key, v in partial(batches):
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int32()), "v": pa.array([v.ravel().tobytes()], pa.binary())})

    def added(t: pa.Table) -> pa.Table:
        total = 0.0
        for v in t["v"]:
            total = total + np.frombuffer(v.as_buffer(), np.float64)
        return pa.table({"key": t["key"].slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(vectors, "key int, v binary")
    if tasks > 64:
        parts = parts.withColumn("_b", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("key", "_b").applyInArrow(
            lambda t: added(t.select(["key", "v"])), "key int, v binary")
    out: dict[int, np.ndarray] = {}
    for r in parts.collect():  # sums of jobs, not rows
        out[r["key"]] = out.get(r["key"], 0.0) + np.frombuffer(r["v"], np.float64)
    return out


def _groups(jobs: list[tuple], folds: int, size: np.ndarray, features: int, classes: int) -> list[Group]:
    by: dict[tuple, list] = {}
    for key in jobs:
        by.setdefault((key[1], 0.0 if key[0] == "mlp" else key[2]), []).extend((key, f) for f in range(folds))
    out = []
    for (loss, gamma), members in by.items():
        keys, held = [k for k, _ in members], np.array([f for _, f in members])
        n = size.sum() - size[held]
        if loss in ("tanh", "relu"):
            rng = np.random.default_rng(SEED)
            first = rng.uniform(-1, 1, (features + 1, HIDDEN)) * math.sqrt(6.0 / (features + HIDDEN))
            second = rng.uniform(-1, 1, (HIDDEN, classes)) * math.sqrt(6.0 / (HIDDEN + classes))
            weights = [np.repeat(w[None], len(keys), 0) for w in (first, second, np.zeros(classes))]
            l2 = np.array([k[2] for k in keys]) / n
            l1 = np.zeros(len(keys))
        else:
            weights = [np.zeros((len(keys), (DIMS if gamma else features) + 1, classes))]
            pen = np.array([k[4] / 10.0 if k[0] == "nusvc" else 1.0 / k[4] / m for k, m in zip(keys, n)])
            l1 = np.where([k[3] == "l1" for k in keys], pen, 0.0)
            l2 = pen - l1
        out.append(Group(loss, gamma, keys, held, l1, l2, weights))
    return out


def _step_linear(g: Group, on: np.ndarray, grad: list, n: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Accelerated proximal step with restart for the jobs `on`; the change of each."""
    s = g.state
    rate = 1.0 / ({"ovr": 0.25, "softmax": 0.5, "hinge": 2.0}[g.loss] * top[g.folds[on]] + g.l2[on])
    at, old = g.weights[0][on], s["x"][on]
    pen = np.ones((1, at.shape[1], 1))
    pen[:, 0] = 0.0
    d = grad[0] / n[:, None, None] + g.l2[on][:, None, None] * pen * at
    new = at - rate[:, None, None] * d
    cut = (rate * g.l1[on])[:, None, None] * pen
    new = np.sign(new) * np.maximum(np.abs(new) - cut, 0.0)
    back = ((at - new) * (new - old)).sum((1, 2)) > 0
    t = np.where(back, 1.0, s["t"][on])
    nxt = (1.0 + np.sqrt(1.0 + 4.0 * t * t)) / 2.0
    g.weights[0][on] = new + np.where(back, 0.0, (t - 1.0) / nxt)[:, None, None] * (new - old)
    s["x"][on], s["t"][on] = new, nxt
    return np.abs(new - old).max((1, 2))


def _step_network(g: Group, on: np.ndarray, grad: list, n: np.ndarray, k: int, rate: float = 1e-3) -> np.ndarray:
    """Adam step; the largest change of a job's weights."""
    move = np.zeros(on.sum())
    for i, w in enumerate(g.weights):
        shape = (-1,) + (1,) * (w.ndim - 1)
        d = grad[i] / n.reshape(shape)
        if i < 2:
            d = d + g.l2[on].reshape(shape) * w[on]
        m, v = g.state["m"][i], g.state["v"][i]
        m[on] = 0.9 * m[on] + 0.1 * d
        v[on] = 0.999 * v[on] + 0.001 * d * d
        step = rate * (m[on] / (1 - 0.9 ** k)) / (np.sqrt(v[on] / (1 - 0.999 ** k)) + 1e-8)
        w[on] -= step
        move = np.maximum(move, np.abs(step).reshape(len(step), -1).max(1))
    return move


def fit_jobs(rows: DataFrame, jobs: list[tuple], folds: int, size: np.ndarray, features: int, classes: int,
             rounds: int = 1000, tol: float = 1e-5) -> list[Group]:
    """All jobs fitted in shared passes over rows (x, y, fold); weights are candidates x folds x features x classes numbers."""
    groups = _groups(jobs, folds, size, features, classes)
    sc = rows.sparkSession.sparkContext
    maps = sorted({g.gamma for g in groups if g.loss not in ("tanh", "relu")})

    def squares(batches):
        acc: dict[int, np.ndarray] = {}
        for x, _, f in _blocks(batches, classes):
            for i, gamma in enumerate(maps):
                m = mapped(x, gamma)
                for k in range(folds):
                    p = m[f == k]
                    acc[i * folds + k] = acc.get(i * folds + k, 0.0) + p.T @ p
        yield from acc.items()

    tasks = rows.rdd.getNumPartitions()
    sums = _totals(rows, squares, tasks)
    top = {}
    for i, gamma in enumerate(maps):
        d = (DIMS if gamma else features) + 1
        each = [sums.get(i * folds + k, np.zeros(d * d)).reshape(d, d) for k in range(folds)]
        top[gamma] = np.array([np.linalg.eigvalsh(sum(each) - each[k])[-1] / max(size.sum() - size[k], 1) for k in range(folds)])
    for g in groups:
        if g.loss in ("tanh", "relu"):
            g.state = {"m": [np.zeros_like(w) for w in g.weights], "v": [np.zeros_like(w) for w in g.weights]}
        else:
            g.state = {"x": g.weights[0].copy(), "t": np.ones(len(g.keys))}
    active = [np.ones(len(g.keys), bool) for g in groups]
    for k in range(1, rounds + 1):
        live = [i for i, a in enumerate(active) if a.any()]
        if not live:
            break
        shared = sc.broadcast([(i, *groups[i].subset(active[i])) for i in live])

        def partial(batches, shared=shared):
            acc: dict[int, list] = {}
            for x, y, f in _blocks(batches, classes):
                seen: dict[float, np.ndarray] = {}
                for i, loss, gamma, held, weights in shared.value:
                    if gamma not in seen:
                        seen[gamma] = mapped(x, gamma)
                    d = gradients(loss, seen[gamma], y, (held[:, None] != f[None, :]).astype(float), weights)
                    acc[i] = d if i not in acc else [a + b for a, b in zip(acc[i], d)]
            for i, d in acc.items():
                yield i, np.concatenate([a.ravel() for a in d])

        total = _totals(rows, partial, tasks)
        shared.destroy()
        for i in live:
            g, on = groups[i], active[i]
            shapes = [w[on].shape for w in g.weights]
            ends = np.cumsum([math.prod(s) for s in shapes])
            flat = total.get(i, np.zeros(ends[-1]))
            grad = [flat[e - math.prod(s):e].reshape(s) for s, e in zip(shapes, ends)]
            n = np.maximum(size.sum() - size[g.folds[on]], 1).astype(float)
            move = _step_network(g, on, grad, n, k) if g.loss in ("tanh", "relu") else _step_linear(g, on, grad, n, top[g.gamma])
            active[i][np.flatnonzero(on)[move < tol]] = False
    for g in groups:
        if "x" in g.state:
            g.weights[0] = g.state["x"]
    return groups


def _hits(rows: DataFrame, groups: list[Group], classes: int) -> dict[tuple, int]:
    """Held-out rows judged rightly per (settings, fold), in one pass."""
    shared = rows.sparkSession.sparkContext.broadcast([g.subset(np.ones(len(g.keys), bool)) for g in groups])

    def partial(batches):
        acc: dict[int, np.ndarray] = {}
        for x, y, f in _blocks(batches, classes):
            for i, (loss, gamma, held, weights) in enumerate(shared.value):
                z, _ = scores(loss, mapped(x, gamma), weights)
                right = (z.argmax(2) == y.argmax(1)[None, :]) & (held[:, None] == f[None, :])
                acc[i] = acc.get(i, 0.0) + right.sum(1).astype(float)
        yield from acc.items()

    total = _totals(rows, partial, rows.rdd.getNumPartitions())
    shared.destroy()
    return {(key, int(f)): int(h) for i, g in enumerate(groups) for key, f, h in
            zip(g.keys, g.folds, total.get(i, np.zeros(len(g.keys))))}


# ---- neighbours and trees --------------------------------------------------------------------------------

def _knn_hits(rows: DataFrame, jobs: list[tuple], folds: int) -> dict[tuple, int]:
    ks = sorted({k for _, k, _ in jobs})
    near = None
    for f in range(folds):
        one = nearest.knn(rows.where(F.col("fold") == f).select(F.col("id").alias("qid"), "x"),
                          rows.where(F.col("fold") != f).select(F.col("id").alias("tid"), "x", F.col("y").alias("label")), ks[-1])
        one = one.withColumn("fold", F.lit(f))
        near = one if near is None else near.unionByName(one)
    v = near.select("qid", "fold", "label", F.coalesce(F.try_divide(F.lit(1.0), F.col("distance")), F.lit(1e300)).alias("w"),
                    F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank"))).alias("k"))
    v = v.groupBy("qid", "fold", "k", "label").agg(F.count(F.lit(1)).cast("double").alias("uniform"), F.sum("w").alias("distance"))
    best = v.groupBy("qid", "fold", "k").agg(*[F.max_by("label", F.struct(w, -F.col("label"))).alias(w) for w in ("uniform", "distance")])
    got = best.join(rows.select(F.col("id").alias("qid"), "y"), "qid").groupBy("fold", "k").agg(
        *[F.sum((F.col(w) == F.col("y")).cast("long")).alias(w) for w in ("uniform", "distance")])
    return {(("knn", r["k"], w), r["fold"]): r[w] for r in got.collect() for w in ("uniform", "distance")}  # folds x ks rows


def _tree_hits(rows: DataFrame, jobs: list[tuple], folds: int, parallelism: int) -> dict[tuple, int]:
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    data = rows.select("fold", F.col("y").cast("double").alias("label"), array_to_vector("x").alias("features")).cache()

    def one(job):
        (key, f) = job
        _, trees, depth, least, bootstrap = key
        m = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=least, bootstrap=bootstrap,
                                   featureSubsetStrategy="sqrt", seed=SEED).fit(data.where(F.col("fold") != f))
        return job, m.transform(data.where(F.col("fold") == f)).where(F.col("prediction") == F.col("label")).count()

    with ThreadPoolExecutor(parallelism) as pool:
        out = dict(pool.map(one, [(k, f) for k in jobs for f in range(folds)]))
    data.unpersist()
    return out


# ---- the search ---------------------------------------------------------------------------------------

def search(models, df: DataFrame, features, label: str = "label", row_id: str = "case_id", folds: int = 3, tried=None,
           seed: int = SEED, rounds: int = 1000, tol: float = 1e-5, parallelism: int = 4) -> DataFrame:
    """(model, candidate, params, fold, accuracy, mean_accuracy, best): held-out accuracy of every candidate on every fold.

    `params` is JSON; `best` marks the candidate of the highest mean, the first on ties. `tried` gives lists of settings by
    model instead of :func:`candidates`. Rows without a label are left out; a missing value in a feature is taken for 0.
    """
    import json

    features = list(features)
    df = df.where(F.col(label).isNotNull())
    classes = tabular.classes(df, label)
    place = F.create_map(*[v for k, c in enumerate(classes) for v in (F.lit(c), F.lit(k))])
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    rows = stage(ordering.stratified_folds(df.select(F.col(row_id).alias("id"), F.col(label).alias("label"), x.alias("x")), "label", "id", folds)
                 .select("id", "x", F.element_at(place, F.col("label")).cast("int").alias("y"), F.col("fold").cast("int").alias("fold")), "search")
    size = np.zeros(folds)
    for r in rows.groupBy("fold").count().collect():
        size[r["fold"]] = r["count"]
    tried = {m: (tried or {}).get(m) or candidates(m, len(classes), seed) for m in models}
    jobs = {m: list(dict.fromkeys(effective(m, c, len(features)) for c in tried[m])) for m in models}
    hits: dict[tuple, int] = {}
    stepped = [k for m in models if m in (*LINEAR, "mlp") for k in jobs[m]]
    rows = rows.cache()  # of a staged table: lost blocks are read again
    if stepped:
        groups = fit_jobs(rows, stepped, folds, size, len(features), len(classes), rounds, tol)
        hits.update(_hits(rows, groups, len(classes)))
    if "knn" in jobs:
        hits.update(_knn_hits(rows, jobs["knn"], folds))
    trees = [k for m in ("decision", "random") for k in jobs.get(m, ())]
    if trees:
        hits.update(_tree_hits(rows, trees, folds, parallelism))
    rows.unpersist()
    out = []
    for m in models:
        acc = [[float(hits.get((effective(m, c, len(features)), f), 0) / max(size[f], 1)) for f in range(folds)] for c in tried[m]]
        means = [round(sum(a) / folds, 12) for a in acc]
        top = means.index(max(means))
        out += [(m, i, json.dumps(c, sort_keys=True), f, acc[i][f], means[i], i == top)
                for i, c in enumerate(tried[m]) for f in range(folds)]
    return df.sparkSession.createDataFrame(
        out, "model string, candidate int, params string, fold int, accuracy double, mean_accuracy double, best boolean")
