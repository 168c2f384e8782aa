"""Feature selection. Data is read in a few aggregates; only p x p sized sums reach the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.operators import ordering, tabular
from voxelframe.session import stage


def variance_filter(long: DataFrame, threshold: float) -> DataFrame:
    """(feature, variance, keep) on min-max data; a threshold nothing passes falls back to 0."""
    v = tabular.minmax(tabular.impute(long)).groupBy("feature").agg(F.var_pop("value").alias("variance"))
    best = v.agg(F.max("variance").alias("top"))
    v = v.withColumn("_one", F.lit(1)).join(F.broadcast(best.withColumn("_one", F.lit(1))), "_one").drop("_one")
    cut = F.when(F.col("top") > threshold, F.lit(threshold)).otherwise(0.0)
    return v.select("feature", "variance", (F.col("variance") > cut).alias("keep"))


def anova_f(long: DataFrame) -> DataFrame:
    """(feature, f, df1, df2): one-way F of value by label; one aggregate over (feature, label)."""
    g = long.groupBy("feature", "label").agg(F.count("value").cast("double").alias("n"), F.avg("value").alias("m"),
                                             F.var_pop("value").alias("v"))
    s = g.groupBy("feature").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("v")).alias("ssw"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("m")).alias("t"))
    df1, df2 = F.col("k") - 1.0, F.col("n") - F.col("k")
    ssb = F.col("q") - F.col("t") * F.col("t") / F.col("n")
    return s.select("feature", F.try_divide(ssb / df1, F.col("ssw") / df2).alias("f"), df1.alias("df1"), df2.alias("df2"))


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    if f is None or not f > 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_cf(a, b, x) / a
    return 1.0 - front * _beta_cf(b, a, 1.0 - x) / b


def with_pvalue(scores: DataFrame) -> DataFrame:
    """One row per feature: the tail of the F distribution is not a built-in."""

    @F.pandas_udf("double")
    def tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return pd.Series([f_tail(*t) for t in zip(f, d1, d2)])

    return scores.withColumn("p_value", tail("f", "df1", "df2"))


def k_best(long: DataFrame, k: int) -> DataFrame:
    """(feature, f, keep): the k highest F scores, ties by name."""
    s = anova_f(long).select("feature", "f")
    top = s.orderBy(F.desc_nulls_last("f"), "feature").limit(k).select("feature", F.lit(True).alias("keep"))
    return s.join(top, "feature", "left").withColumn("keep", F.coalesce("keep", F.lit(False)))


def chain(long: DataFrame, steps) -> tuple[DataFrame, DataFrame]:
    """Filters in order on the survivors: (feature x filter 0/1 matrix, raw survivors)."""
    matrix = long.select("feature").distinct()
    cur = long
    for name, fn in steps:
        kept = fn(cur).where("keep").select("feature")
        matrix = matrix.join(kept.withColumn(name, F.lit(1)), "feature", "left").fillna(0, [name])
        cur = cur.join(kept, "feature", "left_semi")
    return matrix, cur


# ---- sufficient statistics -------------------------------------------------------------------------

def gram(df: DataFrame, columns, group: str) -> dict[int, np.ndarray]:
    """Sums of products of [1, columns..] per group: each task adds up its rows, Spark adds the tasks."""
    cols = list(columns)
    w = len(cols) + 1

    def partial(batches):
        acc = {}
        for b in batches:
            for g, part in b.groupby("_g"):
                x = np.hstack([np.ones((len(part), 1)), part[cols].to_numpy(float)])
                acc[g] = acc.get(g, 0.0) + x.T @ x
        for g, m in acc.items():
            i, j = np.triu_indices(w)
            yield pd.DataFrame({"g": g, "k": i * w + j, "s": m[i, j]})

    src = df.select(F.col(group).cast("int").alias("_g"), *cols)
    sums = src.mapInPandas(partial, "g int, k int, s double").groupBy("g", "k").agg(F.sum("s").alias("s"))
    out: dict[int, np.ndarray] = {}
    for r in sums.toLocalIterator():  # groups x p^2 / 2 sums
        m = out.setdefault(r["g"], np.zeros((w, w)))
        i, j = divmod(r["k"], w)
        m[i, j] = m[j, i] = r["s"]
    return out


def _centred(z: np.ndarray, p: int):
    """(n, xbar, ybar, X'X, X'y) of centred columns from a Gram matrix of [1, x.., y..]."""
    n = z[0, 0]
    mu = z[0, 1:] / n
    c = z[1:, 1:] - n * np.outer(mu, mu)
    return n, mu[:p], mu[p:], c[:p, :p], c[:p, p:], c[p:, p:]


def _lasso_solve(g: np.ndarray, c: np.ndarray, alpha: float, b: np.ndarray, tol=1e-7, rounds=2000) -> np.ndarray:
    """Coordinate descent on 0.5 b'Gb - c'b + alpha |b|."""
    d = np.diag(g)
    r = c - g @ b
    for _ in range(rounds):
        move = 0.0
        for j in np.flatnonzero(d > 0):
            old = b[j]
            z = r[j] + d[j] * old
            new = math.copysign(max(abs(z) - alpha, 0.0), z) / d[j]
            if new != old:
                r -= g[:, j] * (new - old)
                b[j] = new
                move = max(move, abs(new - old))
        if move < tol:
            break
    return b


def _fold_sums(df, features, target_cols, label, row_id, folds):
    f = ordering.stratified_folds(df, label, row_id, folds)
    return gram(f, [*features, *target_cols], "fold")


def _chains(spark, jobs: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """Coefficients [alpha, feature] of warm-started chains of strengths, each chain (G, c, alphas) in a task of its own."""
    shared = spark.sparkContext.broadcast(jobs)  # a p x p matrix for each chain

    def solve(batches):
        for batch in batches:
            for name in batch["name"]:
                g, c, alphas = shared.value[name]
                b = np.zeros(len(c))
                rows = []
                for a in alphas:
                    b = _lasso_solve(g, c, a, b)
                    rows.append(b.copy())
                yield pd.DataFrame({"name": name, "k": range(len(rows)), "coef": [r.tolist() for r in rows]})

    names = spark.createDataFrame([(n,) for n in jobs], "name string").repartition(len(jobs), "name")
    out = {n: np.zeros((len(j[2]), len(j[1]))) for n, j in jobs.items()}
    for r in names.mapInPandas(solve, "name string, k int, coef array<double>").collect():  # chains x alphas x p numbers
        out[r["name"]][r["k"]] = r["coef"]
    return out


def lasso_cv(df: DataFrame, features, y: str, label: str, row_id: str, folds: int = 5, n_alphas: int = 100):
    """dict(alpha, coef, alphas, mse[alpha, fold], path_alphas, path[alpha, feature]).

    Rows are read once for fold-wise Gram sums; the chain of each fold, and that of all rows, is solved in its own task.
    """
    return lasso_from(df.sparkSession, _fold_sums(df, list(features), [y], label, row_id, folds), n_alphas)


def lasso_from(spark, parts: dict[int, np.ndarray], n_alphas: int = 100) -> dict:
    """lasso_cv() from the sums of each fold over [1, features.., target]."""
    total = sum(parts.values())
    p = len(total) - 2
    n, _, _, xx, xy, _ = _centred(total, p)
    top = np.abs(xy[:, 0]).max() / n
    alphas = np.logspace(math.log10(top), math.log10(top * 1e-3), n_alphas)
    jobs, means = {"all": (xx / n, xy[:, 0] / n, alphas)}, {}
    for f in range(len(parts)):
        m, mu, yb, gx, gy, _ = _centred(total - parts[f], p)
        jobs[f"fold{f}"], means[f] = (gx / m, gy[:, 0] / m, alphas), (mu, yb[0])
    found = _chains(spark, jobs)
    mse = np.zeros((n_alphas, len(parts)))
    for f, (mu, yb) in means.items():
        for k, b in enumerate(found[f"fold{f}"]):
            full = np.concatenate([[yb - mu @ b], b, [-1.0]])  # residual = z . full
            mse[k, f] = full @ parts[f] @ full / parts[f][0, 0]
    best = int(mse.mean(axis=1).argmin())
    raw_g, raw_c = total[1:p + 1, 1:p + 1] / n, total[1:p + 1, p + 1] / n
    path_alphas = np.linspace(alphas[best], 0.5, 100)[::-1]
    path = _chains(spark, {"path": (raw_g, raw_c, path_alphas)})["path"]
    return {"alpha": alphas[best], "coef": found["all"][best], "alphas": alphas, "mse": mse, "path_alphas": path_alphas, "path": path}


def ridge_cv(df: DataFrame, features, y: str, label: str, row_id: str, alphas=(0.1, 1.0, 10.0), folds: int = 5):
    """(alpha, coef) of a ridge fit to targets of -1 / 1, alpha by the mean held-out R2."""
    a, coef = ridge_from([_fold_sums(df, list(features), [y], label, row_id, folds)], alphas)
    return a, coef[0]


def ridge_from(targets, alphas=(0.1, 1.0, 10.0)) -> tuple[float, np.ndarray]:
    """(alpha, coef [target, feature]): for each target the sums of each fold over [1, features.., target]; one alpha for all.

    A fold in which a target does not vary says nothing about it.
    """
    score = np.zeros(len(alphas))
    for parts in targets:
        total = sum(parts.values())
        p = len(total) - 2
        for test in parts.values():
            m, mu, yb, gx, gy, _ = _centred(total - test, p)
            ss = test[-1, -1] - test[0, -1] ** 2 / max(test[0, 0], 1.0)
            if ss <= 0:
                continue
            for k, a in enumerate(alphas):
                b = np.linalg.solve(gx + a * np.eye(p), gy[:, 0])
                full = np.concatenate([[yb[0] - mu @ b], b, [-1.0]])
                score[k] += 1.0 - (full @ test @ full) / ss
    a = alphas[int(score.argmax())]
    coef = []
    for parts in targets:
        _, _, _, gx, gy, _ = _centred(sum(parts.values()), len(next(iter(parts.values()))) - 2)
        coef.append(np.linalg.solve(gx + a * np.eye(len(gx)), gy[:, 0]))
    return a, np.array(coef)


def coefficient_table(spark, features, coef, keep) -> DataFrame:
    rows = [(f, float(c), bool(k)) for f, c, k in zip(features, coef, keep)]
    return spark.createDataFrame(rows, "feature string, coef double, keep boolean")


def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df)


def l1_logistic(df: DataFrame, features, label: str, row_id: str, grid=(0.3, 0.1, 0.03), folds: int = 3) -> DataFrame:
    """(feature, coef, keep) of an L1 logistic fit, strength chosen on stratified folds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    data = assemble(ordering.stratified_folds(df, label, row_id, folds), features)
    lr = LogisticRegression(labelCol=label, elasticNetParam=1.0, standardization=False, maxIter=50)
    params = ParamGridBuilder().addGrid(lr.regParam, list(grid)).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=params, numFolds=folds, foldCol="fold", parallelism=4,
                        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"))
    best = cv.fit(data).bestModel
    c = np.abs(best.coefficientMatrix.toArray()).max(axis=0)
    return coefficient_table(df.sparkSession, features, c, c != 0)


def tree_importance(df: DataFrame, features, label: str, binary: bool = True, rounds: int = 20) -> DataFrame:
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

    est = (GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=3, seed=42) if binary
           else RandomForestClassifier(labelCol=label, numTrees=100, seed=42))
    imp = est.fit(assemble(df, features)).featureImportances.toArray()
    return coefficient_table(df.sparkSession, features, imp, imp > 0)


# ---- a whole chain on one set of sums --------------------------------------------------------------------

@dataclass(frozen=True)
class Sums:
    """Products of [1, features..] summed per (fold, class): folds x classes x p^2 numbers, read from the rows once."""

    features: list[str]
    classes: list
    folds: int
    parts: dict[int, np.ndarray]   # fold * number of classes + class

    def of(self, on, folds=None, cls=None) -> np.ndarray:
        """The sums over some folds (all) and one class (all) of the features numbered `on`."""
        rows = np.concatenate([[0], np.asarray(on, int) + 1])
        k = len(self.classes)
        keys = [f * k + c for f in (range(self.folds) if folds is None else folds) for c in (range(k) if cls is None else [cls])]
        return sum((self.parts[i][np.ix_(rows, rows)] for i in keys if i in self.parts), np.zeros((len(rows), len(rows))))

    def with_target(self, on, codes) -> dict[int, np.ndarray]:
        """By fold, the sums over [1, features.., target] for a target that is one number per class."""
        out, w = {}, len(on) + 2
        for f in range(self.folds):
            m = np.zeros((w, w))
            for c, code in enumerate(codes):
                g = self.of(on, [f], c)
                m[:-1, :-1] += g
                m[-1, :-1] += code * g[0]
                m[-1, -1] += code * code * g[0, 0]
            m[:-1, -1] = m[-1, :-1]
            out[f] = m
        return out


def scaled_frame(df: DataFrame, features, label: str, row_id: str, folds: int, classes) -> DataFrame:
    """Staged (row_id, label, fold, part, features..): means for missing values, each feature from 0 to 1, constant ones 0."""
    features = list(features)
    s = df.select(*[f(F.col(c).cast("double")).alias(f"{tag}_{i}") for i, c in enumerate(features)
                    for tag, f in (("lo", F.min), ("hi", F.max), ("av", F.avg))]).first()
    cols = []
    for i, c in enumerate(features):
        low, span = s[f"lo_{i}"] or 0.0, (s[f"hi_{i}"] or 0.0) - (s[f"lo_{i}"] or 0.0)
        v = F.coalesce(F.col(c).cast("double"), F.lit(s[f"av_{i}"] or 0.0))
        cols.append(((v - low) / span if span else F.lit(0.0)).alias(c))
    place = F.create_map(*[v for k, c in enumerate(classes) for v in (F.lit(c), F.lit(k))])
    rows = ordering.stratified_folds(df.where(F.col(label).isNotNull()), label, row_id, folds)
    return stage(rows.select(row_id, F.col(label), "fold", (F.col("fold") * len(classes) + F.element_at(place, F.col(label))).alias("part"), *cols), "scaled")


def _by_variance(s: Sums, on, threshold: float) -> list[int]:
    m = s.of(on)
    v = np.diag(m)[1:] / m[0, 0] - (m[0, 1:] / m[0, 0]) ** 2
    cut = threshold if (v > threshold).any() else 0.0
    return [f for f, x in zip(on, v) if x > cut]


def _by_f(s: Sums, on, k: int) -> list[int]:
    every = [s.of(on, cls=c) for c in range(len(s.classes))]
    total = sum(every)
    n, mean = total[0, 0], total[0, 1:] / total[0, 0]
    between = sum(m[0, 0] * (m[0, 1:] / m[0, 0] - mean) ** 2 for m in every)
    within = sum(np.diag(m)[1:] - m[0, 1:] ** 2 / m[0, 0] for m in every)
    with np.errstate(divide="ignore", invalid="ignore"):
        f = np.nan_to_num((between / (len(every) - 1)) / (within / (n - len(every))), nan=-1.0)
    best = sorted(range(len(on)), key=lambda i: (-f[i], s.features[on[i]]))[:k]
    return sorted(on[i] for i in best)


STEPS = ("variance", "k_best", "lasso", "ridge", "l1_logistic", "tree")


def prepare(df: DataFrame, features, label: str = "label", row_id: str = "case_id", folds: int = 5) -> tuple[DataFrame, Sums]:
    """The staged scaled rows and their sums: what any number of chains take."""
    features, classes = list(features), tabular.classes(df, label)
    rows = scaled_frame(df, features, label, row_id, folds, classes)
    return rows, Sums(features, classes, folds, gram(rows, features, "part"))


def chain_on_sums(prepared: tuple[DataFrame, Sums], steps, row_id: str = "case_id"):
    """(feature x step 0/1 matrix, names of the survivors) of filters in any order, each on what the one before left.

    `steps` are (name of STEPS, settings). Variance, F scores, lasso (on class numbers) and ridge (each class against the rest,
    largest absolute coefficient above 0.10) take rows and columns of one set of sums and do not read the data again; the
    logistic and the tree filter read the surviving columns of the staged table. Rows without a label are left out. A step
    that keeps nothing leaves zeros for the rest.
    """
    unknown = [n for n, _ in steps if n not in STEPS]
    if unknown:
        raise ValueError(f"no filter {', '.join(unknown)}; known are {', '.join(STEPS)}")
    rows, s = prepared
    spark, classes, features = rows.sparkSession, s.classes, s.features
    on, marks = list(range(len(features))), {}
    for name, settings in steps:
        names = [features[i] for i in on]
        if not on:
            kept = []
        elif name == "variance":
            kept = _by_variance(s, on, settings.get("threshold", 0.0))
        elif name == "k_best":
            kept = _by_f(s, on, settings.get("k", 300))
        elif name == "lasso":
            coef = lasso_from(spark, s.with_target(on, [float(c) for c in range(len(classes))]), **settings)["coef"]
            kept = [f for f, c in zip(on, coef) if c != 0]
        elif name == "ridge":
            sides = range(1, 2) if len(classes) == 2 else range(len(classes))
            coef = ridge_from([s.with_target(on, [1.0 if c == t else -1.0 for c in range(len(classes))]) for t in sides], **settings)[1]
            kept = [f for f, c in zip(on, np.abs(coef).max(axis=0)) if c > 0.10]
        else:
            place = F.col("part") % len(classes)
            some = rows.select(row_id, place.cast("double").alias("y"), *names)
            t = (l1_logistic(some, names, "y", row_id, **settings) if name == "l1_logistic"
                 else tree_importance(some, names, "y", len(classes) == 2, **settings))
            found = {r["feature"] for r in t.where("keep").collect()}  # at most one row a feature
            kept = [i for i in on if features[i] in found]
        marks[name], on = set(kept), kept
    table = [(f, *[int(i in marks[n]) for n, _ in steps]) for i, f in enumerate(features)]
    return (spark.createDataFrame(table, "feature string, " + ", ".join(f"`{n}` int" for n, _ in steps)), [features[i] for i in on])
