"""Classifiers by name, cross-validated training and scoring on Spark ML."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.operators import boosting, nearest, ordering, select, tabular
from voxelframe.session import cut_lineage, stage

# fixed values: accepted model names
MODELS = ("svc", "nusvc", "bayesgaussian", "bayesbernoulli", "knn", "logistic", "decision", "random", "xgboost",
          "catboost", "mlp", "adaboost", "lineardiscriminant", "quadraticdiscriminant", "sgd", "bagging")


def estimator(name: str, features: int, classes: int, **params):
    """Spark ML estimator of a model name; margin and boosted models go one-vs-rest beyond two classes."""
    from pyspark.ml import classification as c

    if name in ("svc", "nusvc", "sgd"):
        reg = params.pop("regParam", 0.01 if name != "nusvc" else params.pop("nu", 0.5) / 10.0)
        est = c.LinearSVC(regParam=reg, maxIter=params.pop("maxIter", 50), **params)
    elif name == "logistic":
        return c.LogisticRegression(maxIter=params.pop("maxIter", 100), **params)
    elif name == "decision":
        return c.DecisionTreeClassifier(seed=42, **params)
    elif name == "random":
        return c.RandomForestClassifier(numTrees=params.pop("numTrees", 100), maxDepth=params.pop("maxDepth", 30), seed=42, **params)
    elif name == "bagging":
        return c.RandomForestClassifier(numTrees=params.pop("numTrees", 10), maxDepth=params.pop("maxDepth", 30),
                                        featureSubsetStrategy="all", seed=42, **params)
    elif name == "mlp":
        return c.MultilayerPerceptronClassifier(layers=[features, *params.pop("hidden", (100,)), classes], seed=42,
                                                maxIter=params.pop("maxIter", 200), **params)
    else:
        raise ValueError(f"no Spark ML estimator for {name}")
    return est if classes <= 2 else c.OneVsRest(classifier=est, parallelism=4)


def fourier_features(df: DataFrame, features, gamma: float, dims: int = 256, seed: int = 42) -> DataFrame:
    """Random Fourier map of an rbf kernel: cos(w.x + b) columns for a linear margin model, a matrix product a batch."""
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=math.sqrt(2 * gamma), size=(len(features), dims))
    b = rng.uniform(0, 2 * math.pi, dims)

    @F.pandas_udf("array<double>")
    def mapped(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.cos(np.vstack(x.to_numpy()) @ w + b) * math.sqrt(2.0 / dims)))

    rest = [c for c in df.columns if c not in features]
    out = df.withColumn("_rf", mapped(F.array(*[F.col(c).cast("double") for c in features])))
    return out.select(*rest, *[F.get("_rf", F.lit(k)).alias(f"rf{k}") for k in range(dims)])


def fit_predict(name: str, train: DataFrame, test: DataFrame, features, classes: int, label: str = "label", **params):
    """(model, test rows with prediction)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    p = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"),
                         estimator(name, len(list(features)), classes, **params)])
    m = p.fit(train.withColumn("label", F.col(label).cast("double")))
    return m, m.transform(test)


def platt(train_scores: DataFrame, test_scores: DataFrame, score: str = "margin", label: str = "label") -> DataFrame:
    """Probabilities from a margin: a logistic fit of the label on the training margin."""
    from pyspark.ml.classification import LogisticRegression

    m = LogisticRegression(featuresCol="_s", maxIter=50).fit(select.assemble(train_scores, [score], "_s").withColumn(
        "label", F.col(label).cast("double")))
    a, b = float(m.coefficients[0]), float(m.intercept)
    return test_scores.withColumn("p1", 1.0 / (1.0 + F.exp(-(F.col(score) * a + b))))


# ---- naive Bayes ------------------------------------------------------------------------------------

def gaussian_nb(train: DataFrame, test: DataFrame, smoothing: float = 1e-9) -> DataFrame:
    """Long rows (case_id, [label,] feature, value) -> (case_id, label, logp) per class.

    The model is one row per (feature, class); scoring joins it by feature and sums map-side.
    """
    s = train.groupBy("feature", "label").agg(F.avg("value").alias("mu"), F.var_pop("value").alias("var"))
    spread = train.groupBy("feature").agg(F.var_pop("value").alias("v")).agg((F.max("v") * smoothing).alias("e"))
    s = s.withColumn("_k", F.lit(1)).join(F.broadcast(spread.withColumn("_k", F.lit(1))), "_k").drop("_k")  # one row
    s = s.withColumn("var", F.col("var") + F.col("e"))
    rows = train.groupBy("label").agg(F.countDistinct("case_id").alias("n"))
    prior = rows.select("label", F.log(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("prior"))  # one row a class
    d = F.col("value") - F.col("mu")
    term = -0.5 * F.log(2.0 * math.pi * F.col("var")) - d * d / (2.0 * F.col("var"))
    j = test.select("case_id", "feature", "value").join(s, "feature").groupBy("case_id", "label").agg(F.sum(term).alias("ll"))
    return j.join(prior, "label").select("case_id", "label", (F.col("ll") + F.col("prior")).alias("logp"))


def bernoulli_nb(train: DataFrame, test: DataFrame, alpha: float = 1.0) -> DataFrame:
    on = F.when(F.col("value") > 0, 1).otherwise(0)
    s = train.groupBy("feature", "label").agg(F.sum(on).alias("on"), F.count(F.lit(1)).alias("n"))
    p = (F.col("on") + alpha) / (F.col("n") + 2 * alpha)
    s = s.select("feature", "label", F.log(p).alias("l1"), F.log(1.0 - p).alias("l0"))
    rows = train.groupBy("label").agg(F.countDistinct("case_id").alias("n"))
    prior = rows.select("label", F.log(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("prior"))  # one row a class
    j = test.select("case_id", "feature", "value").join(s, "feature").groupBy("case_id", "label").agg(
        F.sum(F.when(F.col("value") > 0, F.col("l1")).otherwise(F.col("l0"))).alias("ll"))
    return j.join(prior, "label").select("case_id", "label", (F.col("ll") + F.col("prior")).alias("logp"))


def most_likely(scores: DataFrame) -> DataFrame:
    """(case_id, predict): highest score, the smallest class on ties."""
    return scores.groupBy("case_id").agg(F.max_by("label", F.struct("logp", -F.col("label"))).alias("predict"))


# ---- discriminants, boosting --------------------------------------------------------------------------

def discriminant(train: DataFrame, test: DataFrame, features, label: str = "label", quadratic: bool = False,
                 ridge: float = 1e-9, scores: bool = False) -> DataFrame:
    """Test rows with ``predict``, or the scores per class; class means and p x p covariances come from one Gram pass."""
    features = list(features)
    sums = select.gram(train, features, label)
    labels = sorted(sums)
    p, total = len(features), sum(m[0, 0] for m in sums.values())
    mu, cov, prior = [], [], []
    for c in labels:
        m = sums[c]
        n = m[0, 0]
        mean = m[0, 1:] / n
        mu.append(mean)
        cov.append(m[1:, 1:] - n * np.outer(mean, mean))
        prior.append(math.log(n / total))
    if quadratic:
        inv = [np.linalg.inv(s / max(sums[c][0, 0] - 1, 1) + ridge * np.eye(p)) for c, s in zip(labels, cov)]
    else:
        inv = [np.linalg.inv(sum(cov) / max(total - len(labels), 1) + ridge * np.eye(p))] * len(labels)
    const = [pr + 0.5 * np.linalg.slogdet(i)[1] for pr, i in zip(prior, inv)]

    @F.pandas_udf("array<double>")
    def measure(x: pd.Series) -> pd.Series:
        z = np.vstack(x.to_numpy())
        return pd.Series(list(np.stack([k - 0.5 * np.einsum("ij,jk,ik->i", z - m, i, z - m) for k, m, i in zip(const, mu, inv)], axis=1)))

    out = test.withColumn("scores", measure(F.array(*[F.col(c).cast("double") for c in features])))
    if scores:
        return out
    names = F.array(*[F.lit(c) for c in labels])
    return out.withColumn("predict", F.get(names, (F.array_position("scores", F.array_max("scores")) - 1).cast("int")).cast("long")).drop("scores")


def stump(train: DataFrame, weight: str = "w") -> tuple[int, float, int, int]:
    """(feature, threshold, class at or below, class above) of the best weighted split of one level; feature -1 for none."""
    from pyspark.ml.classification import DecisionTreeClassifier

    root = DecisionTreeClassifier(maxDepth=1, weightCol=weight, seed=42).fit(train)._java_obj.rootNode()
    if root.subtreeDepth() == 0:
        c = int(root.prediction())
        return -1, 0.0, c, c
    split = root.split()
    return split.featureIndex(), float(split.threshold()), int(root.leftChild().prediction()), int(root.rightChild().prediction())


def boost(train: DataFrame, features, label: str = "label", rounds: int = 200, classes: int = 2) -> list[tuple[int, float, int, int, float]]:
    """Stage-wise boosting of stumps by sample weights: (feature, threshold, low class, high class, vote) per round.

    A stump is five numbers, so the training rows only carry their weight; it is cut from its lineage every few rounds.
    """
    features = list(features)
    tr = select.assemble(train.select(F.col(label).cast("double").alias("label"), *features), features).withColumn("w", F.lit(1.0))
    out = []
    for k in range(rounds):
        f, at, low, high = stump(tr)
        guess = F.lit(low) if f < 0 else F.when(F.col(features[f]) <= at, low).otherwise(high)
        wrong = F.when(guess != F.col("label"), 1.0).otherwise(0.0)
        r = tr.agg(F.sum(F.col("w") * wrong).alias("e"), F.sum("w").alias("t")).first()
        err = r["e"] / r["t"]
        if err >= 1 - 1.0 / classes:
            break
        vote = math.log((1 - err) / max(err, 1e-12)) + math.log(classes - 1)
        out.append((f, at, low, high, vote))
        if err == 0:
            break
        tr = tr.withColumn("w", F.col("w") * F.exp(vote * wrong) / F.lit(r["t"]))
        if k % 5 == 4:
            tr = cut_lineage(tr)
    return out


def boosted_scores(test: DataFrame, features, stumps, classes: int, out: str = "scores") -> DataFrame:
    """Test rows with the share of the votes of each class."""
    f, at, low, high, vote = (np.array(c) for c in zip(*stumps)) if stumps else (np.zeros(0, int),) * 5
    total = vote.sum() or 1.0

    @F.pandas_udf("array<double>")
    def votes(x: pd.Series) -> pd.Series:
        m = np.vstack(x.to_numpy())
        s = np.zeros((len(m), classes))
        rows = np.arange(len(m))
        for k in range(len(f)):
            s[rows, np.where((f[k] < 0) | (m[:, f[k]] <= at[k]), low[k], high[k])] += vote[k]
        return pd.Series(list(s / total))

    return test.withColumn(out, votes(F.array(*[F.col(c).cast("double") for c in features])))


def adaboost(train: DataFrame, test: DataFrame, features, label: str = "label", rounds: int = 200, classes: int = 2) -> DataFrame:
    """Test rows with ``predict``."""
    scored = boosted_scores(test, features, boost(train, features, label, rounds, classes), classes, "_s")
    return scored.withColumn("predict", (F.array_position("_s", F.array_max("_s")) - 1).cast("long")).drop("_s")


# ---- one entry for every model ----------------------------------------------------------------------------

def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, c: a + c))


def _long(df: DataFrame, features, row_id: str, label: str | None = None) -> DataFrame:
    keys = [F.col(row_id).alias("case_id"), *([F.col(label).alias("label")] if label else [])]
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(
        ["case_id", *(["label"] if label else [])], list(features), "feature", "value")


def train_score(name: str, train: DataFrame, test: DataFrame, features, label: str = "label", row_id: str = "case_id",
                classes=None, **params) -> DataFrame:
    """(row_id, label, predict, scores): any accepted model, fitted on train; scores are per class in ascending order, sum 1.

    Classes are those of the training rows unless given. Test rows keep their order of columns out: only id and label stay.
    """
    from pyspark.ml.functions import vector_to_array

    if name not in MODELS:
        raise ValueError(f"no model {name}; known are {', '.join(MODELS)}")
    features = list(features)
    classes = list(classes) if classes is not None else tabular.classes(train, label)
    place = F.create_map(*[v for k, c in enumerate(classes) for v in (F.lit(c), F.lit(k))])
    tr = train.withColumn("_y", F.element_at(place, F.col(label)))
    n = len(classes)
    if name in ("bayesgaussian", "bayesbernoulli"):
        fit = gaussian_nb if name == "bayesgaussian" else bernoulli_nb
        logs = fit(_long(tr, features, row_id, "_y"), _long(test, features, row_id))
        one = logs.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "logp"))).alias("m"))  # a row a class
        scores = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("m", k.cast("int")), F.lit(-1e300)))
        out = test.join(one, test[row_id] == one["case_id"]).select(test[row_id], test[label], softmax(scores).alias("scores"))
    elif name == "knn":
        x = F.array(*[F.col(c).cast("double") for c in features])
        k = params.get("n_neighbors", 20)
        near = nearest.knn(test.select(F.col(row_id).alias("qid"), x.alias("x")), tr.select(F.col(row_id).alias("tid"), x.alias("x"), F.col("_y").alias("y")), k)
        w = F.lit(1.0) if params.get("weights", "uniform") == "uniform" else F.coalesce(F.try_divide(F.lit(1.0), F.col("distance")), F.lit(1e300))
        sums = near.groupBy("qid").agg(F.sum(w).alias("_t"), *[F.sum(F.when(F.col("y") == c, w).otherwise(0.0)).alias(f"_{c}") for c in range(n)])
        out = test.join(sums, test[row_id] == sums["qid"]).select(row_id, label, F.array(*[F.col(f"_{c}") / F.col("_t") for c in range(n)]).alias("scores"))
    elif name in ("lineardiscriminant", "quadraticdiscriminant"):
        d = discriminant(tr, test, features, "_y", name[0] == "q", scores=True, **params)
        out = d.select(row_id, label, softmax(F.col("scores")).alias("scores"))
    elif name in ("xgboost", "catboost"):
        settings = boosting.Settings(**{{"maxIter": "rounds", "maxDepth": "depth"}.get(k, k): v for k, v in params.items()})
        out = boosting.scored(boosting.fit(tr, features, "_y", n, settings), test).select(row_id, label, "scores")
    elif name == "adaboost":
        stumps = boost(tr, features, "_y", params.get("rounds", 200), n)
        out = boosted_scores(test, features, stumps, n).select(row_id, label, "scores")
    else:
        cols, te = features, test
        if name in ("svc", "nusvc") and params.pop("kernel", "rbf") == "rbf":
            gamma, dims = params.pop("gamma", 1.0 / len(features)), params.pop("dims", 256)
            tr, te = (fourier_features(x.select(row_id, *([label, "_y"] if "_y" in x.columns else [label]), *features), features, gamma, dims)
                      for x in (tr, test))
            cols = [c for c in tr.columns if c.startswith("rf")]
        m, pred = fit_predict(name, tr.drop(label) if label == "label" else tr, te, cols, n, "_y", **params)
        raw = vector_to_array("probability") if "probability" in pred.columns else softmax(vector_to_array("rawPrediction"))
        out = pred.select(row_id, F.col(label).alias(label), raw.alias("scores"))
    names = F.array(*[F.lit(c) for c in classes])
    return out.select(row_id, F.col(label).cast("long").alias("label"),
                      F.get(names, F.array_position("scores", F.array_max("scores")).cast("int") - 1).cast("long").alias("predict"), "scores")


def class_rows(scored: DataFrame, classes, keys) -> DataFrame:
    """(keys, class, score, hit): one row per sample and class, as the ROC and AUC functions take them."""
    names = F.array(*[F.lit(str(c)) for c in classes])
    t = scored.select(*keys, "label", F.posexplode("scores").alias("k", "score"))
    return t.select(*keys, F.get(names, F.col("k")).alias("class"), "score",
                    (F.get(names, F.col("k")) == F.col("label").cast("string")).cast("int").alias("hit"))


# ---- folds ---------------------------------------------------------------------------------------------

def cross_validate(name: str, df: DataFrame, features, classes: int, folds: int = 5, row_id: str = "case_id", **params):
    """(models, predictions): each fold fits on the others; both parts are scored (fold, part, label, predict)."""
    data = stage(ordering.stratified_folds(df, "label", row_id, folds), "folds")
    models, out = [], None
    for f in range(folds):
        m, pred = fit_predict(name, data.where(F.col("fold") != f), data, features, classes, **params)
        models.append(m)
        part = F.when(F.col("fold") == f, "valid").otherwise("train")
        one = pred.select(row_id, F.col("label").cast("long").alias("label"), F.col("prediction").cast("long").alias("predict"),
                          part.alias("part"), F.lit(f).alias("fold"))
        out = one if out is None else out.unionByName(one)
    return models, out


def bayes_cross_scores(name: str, data: DataFrame, features, folds: int, label: str, row_id: str, classes, smoothing: float = 1e-9,
                       alpha: float = 1.0) -> DataFrame:
    """cross_scores() of both kinds of naive Bayes for all folds at once: sums per fold add up to those of the others.

    One aggregate of the rows gives the sums, one join scores every row under every fold's model. Values are taken as
    distances to the mean of their feature, so that variances from sums do not cancel.
    """
    classes, every = list(classes), range(folds)
    place = F.create_map(*[v for k, c in enumerate(classes) for v in (F.lit(c), F.lit(k))])
    long = data.select(F.col(row_id).alias("case_id"), F.element_at(place, F.col(label)).alias("y"), "fold",
                       *[F.col(c).cast("double").alias(c) for c in features]).unpivot(["case_id", "y", "fold"], list(features), "feature", "value")
    gaussian = name == "bayesgaussian"
    if gaussian:
        mid = long.groupBy("feature").agg(F.avg("value").alias("mid"))
        long = long.join(mid, "feature").select("case_id", "y", "fold", "feature", (F.col("value") - F.col("mid")).alias("v"))
    else:
        long = long.select("case_id", "y", "fold", "feature", F.when(F.col("value") > 0, 1.0).otherwise(0.0).alias("v"))
    long = stage(long, "bayes-rows")
    v = F.col("v")
    sums = long.groupBy("feature", "y", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2"))
    others = sums.withColumn("k", F.explode(F.array(*[F.lit(k) for k in every]))).where("fold <> k") \
        .groupBy("k", "feature", "y").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")])
    others = stage(others, "bayes-sums")  # folds x features x classes rows
    var = lambda n, s1, s2: F.greatest(s2 / n - (s1 / n) * (s1 / n), F.lit(0.0))
    if gaussian:
        whole = others.groupBy("k", "feature").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")])
        eps = whole.groupBy("k").agg((F.max(var(F.col("n"), F.col("s1"), F.col("s2"))) * smoothing).alias("e"))
        model = others.join(eps, "k").select("k", "feature", F.col("y").alias("c"), (F.col("s1") / F.col("n")).alias("mu"),
                                             (var(F.col("n"), F.col("s1"), F.col("s2")) + F.col("e")).alias("var"))
        d = v - F.col("mu")
        term = -0.5 * F.log(2.0 * math.pi * F.col("var")) - d * d / (2.0 * F.col("var"))
    else:
        p = (F.col("s1") + alpha) / (F.col("n") + 2 * alpha)
        model = others.select("k", "feature", F.col("y").alias("c"), F.log(p).alias("l1"), F.log(1.0 - p).alias("l0"))
        term = F.when(v > 0, F.col("l1")).otherwise(F.col("l0"))
    rows = data.groupBy(F.element_at(place, F.col(label)).alias("c"), "fold").count().withColumn("k", F.explode(F.array(*[F.lit(k) for k in every]))) \
        .where("fold <> k").groupBy("k", "c").agg(F.sum("count").alias("n"))
    prior = rows.select("k", "c", F.log(F.col("n") / F.sum("n").over(Window.partitionBy("k"))).alias("prior"))  # a row a class
    one = long.select("case_id", "feature", "v").join(model, "feature").groupBy("case_id", "k", "c").agg(F.sum(term).alias("ll"))
    one = one.join(prior, ["k", "c"]).groupBy("case_id", "k").agg(F.map_from_entries(F.collect_list(F.struct("c", F.col("ll") + F.col("prior")))).alias("m"))
    logs = F.transform(F.sequence(F.lit(0), F.lit(len(classes) - 1)), lambda k: F.coalesce(F.try_element_at("m", k.cast("int")), F.lit(-1e300)))
    names = F.array(*[F.lit(c) for c in classes])
    out = one.select(F.col("case_id").alias(row_id), F.col("k").alias("fold"), softmax(logs).alias("scores")).join(
        data.select(row_id, F.col(label).cast("long").alias("label"), F.col("fold").alias("own")), row_id)
    return out.select(row_id, "label", F.get(names, F.array_position("scores", F.array_max("scores")).cast("int") - 1).cast("long").alias("predict"),
                      "scores", F.when(F.col("own") == F.col("fold"), "valid").otherwise("train").alias("part"), "fold")


def cross_scores(name: str, df: DataFrame, features, folds: int = 5, label: str = "label", row_id: str = "case_id", **params) -> DataFrame:
    """(fold, part, row_id, label, predict, scores) of any accepted model: each fold is fitted on the others, both parts scored."""
    data = stage(ordering.stratified_folds(df, label, row_id, folds), "folds")
    classes, out = tabular.classes(data, label), None
    if name in ("bayesgaussian", "bayesbernoulli"):
        return bayes_cross_scores(name, data, features, folds, label, row_id, classes, **params)
    for f in range(folds):
        one = train_score(name, data.where(F.col("fold") != f), data, features, label, row_id, classes, **params)
        one = one.join(data.select(row_id, F.when(F.col("fold") == f, "valid").otherwise("train").alias("part")), row_id).withColumn("fold", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out


def score_table(models, df: DataFrame, features, folds: int = 5, label: str = "label", row_id: str = "case_id", params=None) -> DataFrame:
    """(model, fold, part, row_id, label, predict, scores), staged: what reports, curves and the choice of a fold read.

    `params` are those of each model by its name. The scores of a model are staged before the next one is fitted.
    """
    every = [stage(cross_scores(m, df, features, folds, label, row_id, **(params or {}).get(m, {})).withColumn("model", F.lit(m)), f"scores-{m}")
             for m in models]
    return reduce(DataFrame.unionByName, every)


def best_fold(accuracy_by_fold: DataFrame) -> DataFrame:
    """The fold with the highest accuracy, the last one on ties."""
    return accuracy_by_fold.agg(F.max_by("fold", F.struct("accuracy", "fold")).alias("fold"))


def importance(model, features, spark) -> DataFrame:
    """(class, feature, importance) of a tree or logistic model."""
    if hasattr(model, "featureImportances"):
        mat = model.featureImportances.toArray()[None, :]
    else:
        mat = model.coefficientMatrix.toArray()
    rows = [(int(c), f, float(mat[c, j])) for c in range(mat.shape[0]) for j, f in enumerate(features)]
    return spark.createDataFrame(rows, "class int, feature string, importance double")


def probability_map(pred: DataFrame, classes) -> DataFrame:
    """JSON object class -> probability for every row."""
    from pyspark.ml.functions import vector_to_array

    keys = F.array(*[F.lit(str(c)) for c in classes])
    m = F.map_from_arrays(keys, F.transform(vector_to_array("probability"), lambda v: F.round(v, 6)))
    return pred.withColumn("probabilities", F.to_json(m))
