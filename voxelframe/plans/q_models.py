"""Preparation, selection, analysis, classifiers and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxelframe.operators import analyze as an
from voxelframe.operators import evaluate as ev
from voxelframe.operators import boosting, learn, nearest, ordering, search, select, tabular
from voxelframe.plans.catalog import ORACLES, r6, register
from voxelframe.plans.q_tables import _ML, _missing_long, fold_scores
from voxelframe.plans.q_texture import rounded
from voxelframe.session import scratch_path
from voxelframe.sources import tables as T

NAMES = T.feature_names()
CLASSES = 10
LONG = T.SQL_LONG


def _gaps(spark, d):
    """Event values with missing entries, an all-missing and a constant feature."""
    e = _missing_long(spark, d)
    k = e.select("case_id", F.lit("const").alias("feature"), F.lit(3.0).alias("value"))
    n = e.select("case_id", F.lit("empty").alias("feature"), F.lit(None).cast("double").alias("value"))
    return e.unionByName(k).unionByName(n)


_GAPS = (f"gp AS ({_ML} UNION ALL SELECT event_id, 'const', 3.0 FROM events UNION ALL SELECT event_id, 'empty', NULL FROM events), "
         "im AS (SELECT case_id, feature, coalesce(value, avg(value) OVER (PARTITION BY feature), 0.0) AS value FROM gp)")

# ---- preparation ---------------------------------------------------------------------------------------

register("pp_impute", lambda spark, d: rounded(tabular.impute(_gaps(spark, d)).select("case_id", "feature", "value")),
         f"WITH {_GAPS} SELECT case_id, feature, {r6('value')} AS value FROM im")
register("pp_label_encode",
         lambda spark, d: tabular.label_encode(T.table(spark, d, "customer").select("c_custkey", F.when(
             F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("seg")), "seg"),
         """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS seg FROM customer)
SELECT c_custkey, seg, CAST(dense_rank() OVER (ORDER BY coalesce(seg, 'NA')) - 1 AS INT) AS code FROM c""")
register("pp_label_binarize",
         lambda spark, d: tabular.binarize(T.targets(spark, d), "label", ["case_id"]),
         "SELECT vec_id AS case_id, " + ", ".join(f"CASE WHEN label = {c} THEN 1 ELSE 0 END AS c{c}" for c in range(10)) + " FROM embeddings")
register("pp_zscore", lambda spark, d: rounded(tabular.zscore(tabular.impute(_gaps(spark, d))).select("case_id", "feature", "value")),
         f"""WITH {_GAPS}, s AS (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd FROM im GROUP BY 1)
SELECT case_id, feature, {r6('(value - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END')} AS value FROM im JOIN s USING (feature)""")
register("pp_minmax", lambda spark, d: rounded(tabular.minmax(tabular.impute(_gaps(spark, d)), -1.0, 1.0).select("case_id", "feature", "value")),
         f"""WITH {_GAPS}, s AS (SELECT feature, min(value) AS a, max(value) AS b FROM im GROUP BY 1)
SELECT case_id, feature, {r6('CASE WHEN b = a THEN -1 ELSE (value - a) / (b - a) * 2 - 1 END')} AS value FROM im JOIN s USING (feature)""")


def _scaler_apply(spark, d):
    """Statistics fitted on the training part are saved, read back and applied to the test part."""
    long = T.features_long(spark, d)
    path = scratch_path(spark, "scaler")
    tabular.fit_zscore(long.where("case_id % 5 <> 0")).write.mode("overwrite").parquet(path)
    return rounded(tabular.apply_zscore(long.where("case_id % 5 = 0"), spark.read.parquet(path)).select("case_id", "feature", "value"))


register("pp_scaler_apply", _scaler_apply,
         f"""WITH {LONG}, s AS (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd FROM fl WHERE case_id % 5 <> 0 GROUP BY 1)
SELECT case_id, feature, {r6('(value - mu) / sd')} AS value FROM fl JOIN s USING (feature) WHERE case_id % 5 = 0""")

# ---- selection ---------------------------------------------------------------------------------------------

THRESHOLD = 0.025
_MM = f"""{LONG}, mm AS (SELECT *, (value - min(value) OVER (PARTITION BY feature)) / (max(value) OVER (PARTITION BY feature) - min(value) OVER (PARTITION BY feature)) AS u FROM fl),
va AS (SELECT feature, var_pop(u) AS variance FROM mm GROUP BY feature)"""
_AF = """g AS (SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM {src} GROUP BY feature, label),
t AS (SELECT feature, sum(n * m) / sum(n) AS gm FROM g GROUP BY feature),
af AS (SELECT feature, (sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f,
       count(*) - 1.0 AS df1, sum(n) - count(*) AS df2 FROM g JOIN t USING (feature) GROUP BY feature)"""
register("sel_variance", lambda spark, d: rounded(select.variance_filter(T.features_long(spark, d), THRESHOLD)),
         f"WITH {_MM} SELECT feature, {r6('variance')} AS variance, variance > {THRESHOLD} AS keep FROM va")
register("sel_anova_f", lambda spark, d: rounded(select.anova_f(T.features_long(spark, d))),
         f"WITH {LONG}, {_AF.format(src='fl')} SELECT feature, {r6('f')} AS f, CAST(df1 AS DOUBLE) AS df1, CAST(df2 AS DOUBLE) AS df2 FROM af")
register("sel_kbest_pvalue", lambda spark, d: rounded(select.with_pvalue(select.anova_f(T.features_long(spark, d)))))
register("win_top_k", lambda spark, d: rounded(select.k_best(T.features_long(spark, d), 20)),
         f"""WITH {LONG}, {_AF.format(src='fl')} SELECT feature, {r6('f')} AS f, row_number() OVER (ORDER BY f DESC, feature) <= 20 AS keep FROM af""")


def _chain(spark, d):
    m, _ = select.chain(T.features_long(spark, d), [
        ("variance", lambda x: select.variance_filter(x, THRESHOLD)), ("k_best", lambda x: select.k_best(x, 10))])
    return m.withColumns({c: F.col(c).cast("int") for c in ("variance", "k_best")})


register("sel_chain_matrix", _chain,
         f"""WITH {_MM}, sv AS (SELECT * FROM fl WHERE feature IN (SELECT feature FROM va WHERE variance > {THRESHOLD})), {_AF.format(src='sv')},
kb AS (SELECT feature FROM af ORDER BY f DESC, feature LIMIT 10)
SELECT feature, CAST(variance > {THRESHOLD} AS INT) AS variance, CAST(feature IN (SELECT feature FROM kb) AS INT) AS k_best FROM va""")


def frame(spark, d, names=NAMES, binary=True):
    """Wide features with a label: binary is label < 5."""
    f = T.features(spark, d).select("case_id", *names).join(T.targets(spark, d), "case_id")
    return f.withColumn("label", (F.col("label") < 5).cast("long")) if binary else f


SIX = [("variance", {"threshold": THRESHOLD}), ("k_best", {"k": 40}), ("ridge", {}), ("lasso", {}), ("l1_logistic", {}), ("tree", {})]
register("sel_chain_sums", lambda spark, d: select.chain_on_sums(
    select.prepare(frame(spark, d, binary=False), NAMES), [("variance", {"threshold": THRESHOLD}), ("k_best", {"k": 10})])[0],
         ORACLES["sel_chain_matrix"])
register("sel_chain_six", lambda spark, d: select.chain_on_sums(select.prepare(frame(spark, d, binary=False), NAMES), SIX)[0])


def _lasso(spark, d):
    df = frame(spark, d).withColumn("y", F.col("label") * 1.0)
    return df, select.lasso_cv(df, NAMES, "y", "label", "case_id")


register("sel_lasso", lambda spark, d: (lambda df, r: rounded(select.coefficient_table(
    spark, NAMES, r["coef"], r["coef"] != 0).withColumn("alpha", F.lit(float(r["alpha"])))))(*_lasso(spark, d)))
register("sel_lasso_path", lambda spark, d: (lambda df, r: rounded(spark.createDataFrame(
    [(float(a), f, float(r["path"][k, j])) for k, a in enumerate(r["path_alphas"]) for j, f in enumerate(NAMES)],
    "alpha double, feature string, coef double")))(*_lasso(spark, d)))
register("sel_lasso_mse", lambda spark, d: (lambda df, r: rounded(spark.createDataFrame(
    [(float(a), f, float(r["mse"][k, f])) for k, a in enumerate(r["alphas"]) for f in range(r["mse"].shape[1])],
    "alpha double, fold int, mse double")))(*_lasso(spark, d)))


def _ridge(spark, d):
    df = frame(spark, d).withColumn("y", F.col("label") * 2.0 - 1.0)
    a, coef = select.ridge_cv(df, NAMES, "y", "label", "case_id")
    return rounded(select.coefficient_table(spark, NAMES, coef, abs(coef) > 0.10).withColumn("alpha", F.lit(float(a))))


register("sel_ridge", _ridge)
register("sel_l1_logistic", lambda spark, d: rounded(select.l1_logistic(frame(spark, d), NAMES, "label", "case_id")))
register("sel_tree_importance", lambda spark, d: rounded(select.tree_importance(frame(spark, d), NAMES, "label")))

# ---- analysis ------------------------------------------------------------------------------------------------

register("an_pca_ratio", lambda spark, d: rounded(an.pca_ratio(T.features(spark, d), NAMES)))
register("an_pca_loadings", lambda spark, d: rounded(an.pca_loadings(T.features(spark, d), NAMES)))


def _cumulative(spark, d):
    """Running share of the features' variances, largest first."""
    v = T.features_long(spark, d).groupBy("feature").agg(F.var_pop("value").alias("v"))
    tot = Window.partitionBy()
    v = v.select("feature", F.row_number().over(Window.orderBy(F.desc("v"), "feature")).alias("component"),
                 (F.col("v") / F.sum("v").over(tot)).alias("percent"))
    return rounded(an.cumulative(v))


register("agg_cumulative_variance", _cumulative,
         f"""WITH {LONG}, v AS (SELECT feature, var_pop(value) AS v FROM fl GROUP BY 1),
p AS (SELECT feature, CAST(row_number() OVER (ORDER BY v DESC, feature) AS INT) AS component, v / sum(v) OVER () AS percent FROM v)
SELECT feature, component, {r6('percent')} AS percent, {r6('sum(percent) OVER (ORDER BY component)')} AS cumulative FROM p""")
register("an_kmeans", lambda spark, d: an.kmeans(T.features(spark, d), NAMES)[1].select("case_id", "class"))


def arrays(spark, d):
    e = T.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("case_id"), F.col("label").cast("long").alias("label"),
                    F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def _starts(spark, d, k=4):
    rows = arrays(spark, d).where(F.col("case_id") < k).collect()  # k starting centres
    return [r["x"] for r in sorted(rows, key=lambda r: r["case_id"])]


def _lloyd(spark, d, rounds=2):
    a = arrays(spark, d)
    out = an.assign(a, "x", an.lloyd(a, "x", _starts(spark, d), rounds))
    return out.select("case_id", F.concat(F.lit("cluster"), (F.col("cluster") + 1).cast("string")).alias("class"), "distance")


def _lloyd_cte(rounds=2):
    parts = [LONG, "c0 AS (SELECT case_id AS cl, feature, value AS c FROM fl WHERE case_id < 4)"]
    for k in range(rounds + 1):
        parts.append(f"d{k} AS (SELECT case_id, cl, sqrt(sum(pow(value - c, 2))) AS dist FROM fl JOIN c{k} USING (feature) GROUP BY ALL)")
        parts.append(f"a{k} AS (SELECT case_id, arg_min(cl, (dist, cl)) AS cl, min(dist) AS dist FROM d{k} GROUP BY case_id)")
        if k < rounds:
            parts.append(f"c{k + 1} AS (SELECT cl, feature, avg(value) AS c FROM fl JOIN a{k} USING (case_id) GROUP BY ALL)")
    return ", ".join(parts)


register("an_lloyd_fixed", lambda spark, d: _lloyd(spark, d).select("case_id", "class"),
         f"WITH {_lloyd_cte()} SELECT case_id, 'cluster' || (cl + 1) AS class FROM a2")
register("an_centroid_distance", lambda spark, d: rounded(_lloyd(spark, d)),
         f"WITH {_lloyd_cte()} SELECT case_id, 'cluster' || (cl + 1) AS class, {r6('dist')} AS distance FROM a2")
register("agg_cluster_stat", lambda spark, d: rounded(an.cluster_statistics(_lloyd(spark, d))),
         f"""WITH {_lloyd_cte()} SELECT 'cluster' || (cl + 1) AS class, count(*) AS number, {r6('count(*) / sum(count(*)) OVER ()')} AS percent,
{r6('avg(dist)')} AS avg_distance FROM a2 GROUP BY cl""")

# ---- nearest neighbours and naive Bayes ------------------------------------------------------------------------


def _split(spark, d):
    a = arrays(spark, d)
    return (a.where("case_id % 5 = 0").select(F.col("case_id").alias("qid"), "x"),
            a.where("case_id % 5 <> 0").select(F.col("case_id").alias("tid"), "x", "label"))


_KNN = """ds AS (SELECT q.vec_id AS qid, t.vec_id AS tid, CAST(t.label AS BIGINT) AS label, list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS distance
FROM embeddings q JOIN embeddings t ON q.vec_id % 5 = 0 AND t.vec_id % 5 <> 0),
kn AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, tid) AS INT) AS rank FROM ds)"""
register("jn_knn", lambda spark, d: rounded(nearest.knn(*_split(spark, d), 5)),
         f"WITH {_KNN} SELECT qid, tid, {r6('distance')} AS distance, label, rank FROM kn WHERE rank <= 5")
register("clf_knn", lambda spark, d: nearest.vote(nearest.knn(*_split(spark, d), 20)),
         f"""WITH {_KNN}, vo AS (SELECT qid, label, count(*) AS v FROM kn WHERE rank <= 20 GROUP BY ALL)
SELECT qid, arg_max(label, (v, -label)) AS predict FROM vo GROUP BY qid""")


def _nb_split(spark, d):
    long = T.features_long(spark, d)
    return long.where("case_id % 5 <> 0"), long.where("case_id % 5 = 0")


_PRIOR = "pr AS (SELECT label, ln(count(*) / sum(count(*)) OVER ()) AS prior FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY label)"
_NB = {
    "gaussian": f"""{LONG}, {_PRIOR}, ep AS (SELECT max(v) * 1e-9 AS e FROM (SELECT var_pop(value) AS v FROM fl WHERE case_id % 5 <> 0 GROUP BY feature)),
st AS (SELECT feature, label, avg(value) AS mu, var_pop(value) + any_value(e) AS var FROM fl, ep WHERE case_id % 5 <> 0 GROUP BY feature, label),
sc AS (SELECT f.case_id, s.label, sum(-0.5 * ln(2 * pi() * var) - pow(value - mu, 2) / (2 * var)) AS ll FROM fl f JOIN st s USING (feature) WHERE f.case_id % 5 = 0 GROUP BY ALL)""",
    "bernoulli": f"""{LONG}, {_PRIOR}, st AS (SELECT feature, label, (count(CASE WHEN value > 0 THEN 1 END) + 1.0) / (count(*) + 2.0) AS p FROM fl WHERE case_id % 5 <> 0 GROUP BY ALL),
sc AS (SELECT f.case_id, s.label, sum(CASE WHEN value > 0 THEN ln(p) ELSE ln(1 - p) END) AS ll FROM fl f JOIN st s USING (feature) WHERE f.case_id % 5 = 0 GROUP BY ALL)""",
}
for _kind, _fn in (("gaussian", learn.gaussian_nb), ("bernoulli", learn.bernoulli_nb)):
    register(f"clf_bayes_{_kind}",
             lambda spark, d, f=_fn: rounded(f(*_nb_split(spark, d))),
             f"WITH {_NB[_kind]} SELECT case_id, sc.label, {r6('ll + prior')} AS logp FROM sc JOIN pr USING (label)")

# ---- fitted models (rows only) ------------------------------------------------------------------------------------


def _train_test(spark, d):
    df = frame(spark, d, binary=False)
    return df.where("case_id % 5 <> 0"), df.where("case_id % 5 = 0")


def _scored(name, **params):
    def run(spark, d):
        return learn.train_score(name, *_train_test(spark, d), NAMES, **params)
    return run


def _fitted(name, **params):
    return lambda spark, d: _scored(name, **params)(spark, d).select("case_id", "label", "predict")


register("clf_logistic", _fitted("logistic", regParam=0.01))
register("clf_decision_tree", _fitted("decision"))
register("clf_random_forest", _fitted("random"))
register("clf_mlp", _fitted("mlp", maxIter=500))
register("clf_sgd", _fitted("sgd"))
register("clf_bagging", _fitted("bagging"))
register("clf_nusvc", _fitted("nusvc", nu=0.5))
register("ml_one_vs_rest", _fitted("svc", kernel="linear"))
register("clf_lda", _fitted("lineardiscriminant"))
register("clf_qda", _fitted("quadraticdiscriminant"))
register("clf_adaboost", _fitted("adaboost"))


GBT = {"rounds": 10, "depth": 3}   # cut for time: boosting.Settings has 200 rounds of depth 10
register("clf_gbt", _fitted("xgboost", **GBT))
register("clf_svc", _fitted("svc"))


def _gbt_importance(spark, d):
    model = boosting.fit(_train_test(spark, d)[0], NAMES, "label", CLASSES, boosting.Settings(**GBT))
    return rounded(boosting.importance(model.table(spark), NAMES))


register("ml_gbt_importance", _gbt_importance)


def _cv(spark, d, folds=5):
    return learn.cross_validate("logistic", frame(spark, d, binary=False), NAMES, CLASSES, folds, regParam=0.01)


# the models whose five fits take seconds; learn.score_table takes all sixteen
IN_TABLE = ("bayesgaussian", "bayesbernoulli", "knn", "lineardiscriminant", "quadraticdiscriminant", "logistic", "decision")
register("ml_cross_validate", lambda spark, d: rounded(learn.score_table(IN_TABLE, frame(spark, d, binary=False), NAMES).select(
    "model", "fold", "part", "case_id", "label", "predict", *[F.get("scores", F.lit(k)).alias(f"p_{k}") for k in range(CLASSES)])))


def _param_search(models, rounds=40):
    """Every candidate of the models on three folds; gradient fits stop after `rounds` shared passes (search() has 1,000)."""
    return lambda spark, d: rounded(search.search(models, frame(spark, d, binary=False), NAMES, rounds=rounds))


register("ml_param_search", _param_search(("logistic", "svc", "nusvc", "mlp", "knn")))
register("ml_param_search_tree", _param_search(("decision",)))


def _importance(spark, d):
    models, _ = _cv(spark, d)
    out = None
    for f, m in enumerate(models):
        one = learn.importance(m.stages[-1], NAMES, spark).withColumn("fold", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


register("ml_feature_importance", _importance)


def _best_fold(spark, d):
    tr, te = _train_test(spark, d)
    models, pred = learn.cross_validate("logistic", tr, NAMES, CLASSES, 5, regParam=0.01)
    acc = ev.accuracy(pred.where("part = 'valid'"), ["fold"])
    f = learn.best_fold(acc).first()["fold"]
    p = models[f].transform(te).select(F.lit(f).alias("fold"), F.col("label").cast("long").alias("label"),
                                       F.col("prediction").cast("long").alias("predict"))
    return rounded(ev.class_report(p, ["fold"]))


register("ml_test_best_fold", _best_fold)


def _infer(spark, d):
    tr, te = _train_test(spark, d)
    return learn.probability_map(learn.fit_predict("logistic", tr, te, NAMES, CLASSES, regParam=0.01)[1], range(CLASSES))


register("ml_infer_map", lambda spark, d: _infer(spark, d).select("case_id", "probabilities"))


def _infer_batch(spark, d):
    """Every fold's model scores the test rows, joined with the ground truth."""
    from pyspark.ml.functions import vector_to_array

    tr, te = _train_test(spark, d)
    models, _ = learn.cross_validate("logistic", tr, NAMES, CLASSES, 5, regParam=0.01)
    out = None
    for f, m in enumerate(models):
        p = vector_to_array("probability")
        one = m.transform(te).select("case_id", F.lit(f).alias("fold"), *[p[k].alias(f"p_{k}") for k in range(CLASSES)])
        out = one if out is None else out.unionByName(one)
    return rounded(out.join(T.targets(spark, d).withColumnRenamed("label", "truth"), "case_id", "left"))


register("ml_infer_batch", _infer_batch)


def _roundtrip(spark, d):
    from pyspark.ml import PipelineModel

    tr, te = _train_test(spark, d)
    m, _ = learn.fit_predict("logistic", tr, te, NAMES, CLASSES, regParam=0.01)
    path = scratch_path(spark, "model")
    m.write().overwrite().save(path)
    p = PipelineModel.load(path).transform(te)
    return p.select("case_id", F.col("prediction").cast("long").alias("predict"))


register("ml_model_roundtrip", _roundtrip)

# ---- evaluation ---------------------------------------------------------------------------------------------------


def fold_table(spark, d, models=("bayesgaussian",)):
    """Scores of every case under every fold's model, ten classes: (model, fold, part, case_id, label, predict, p_0 .. p_9)."""
    t = learn.score_table(models, frame(spark, d, binary=False), NAMES)
    return t.select("model", "fold", "part", "case_id", "label", "predict", *[F.get("scores", F.lit(k)).alias(f"p_{k}") for k in range(CLASSES)])


def predictions(spark, d):
    """Every case once, by the model that was not fitted on it."""
    return fold_table(spark, d).where("part = 'valid'")


_P = [f"p_{k}" for k in range(CLASSES)]
_TERM = {"gaussian": ("avg(value) AS mu, var_pop(value) + any_value(e) AS var", "-0.5 * ln(2 * pi() * var) - pow(value - mu, 2) / (2 * var)"),
         "bernoulli": ("(count(CASE WHEN value > 0 THEN 1 END) + 1.0) / (count(*) + 2.0) AS p", "CASE WHEN value > 0 THEN ln(p) ELSE ln(1 - p) END")}


def fold_cte(kind="gaussian", tag=""):
    """sd<tag>: the twin of fold_table for one kind of naive Bayes."""
    fit, term = _TERM[kind]
    return f"""tr{tag} AS (SELECT k, fl.* FROM fl JOIN fo USING (case_id) JOIN ks ON fo.fold <> k),
ep{tag} AS (SELECT k, max(v) * 1e-9 AS e FROM (SELECT k, var_pop(value) AS v FROM tr{tag} GROUP BY k, feature) GROUP BY k),
st{tag} AS (SELECT k, feature, label, {fit} FROM tr{tag} JOIN ep{tag} USING (k) GROUP BY k, feature, label),
sc{tag} AS (SELECT k, f.case_id, s.label AS c, sum({term}) AS ll FROM fl f JOIN st{tag} s USING (feature) GROUP BY ALL),
lp{tag} AS (SELECT sc{tag}.*, ll + prior AS logp, max(ll + prior) OVER (PARTITION BY sc{tag}.k, case_id) AS top FROM sc{tag} JOIN pr ON pr.k = sc{tag}.k AND pr.label = c),
so{tag} AS (SELECT *, exp(logp - top) / sum(exp(logp - top)) OVER (PARTITION BY k, case_id) AS p FROM lp{tag}),
sd{tag} AS (SELECT so{tag}.k AS fold, CASE WHEN any_value(fo.fold) = so{tag}.k THEN 'valid' ELSE 'train' END AS part, case_id, any_value(fo.label) AS label,
  arg_max(c, (p, -c)) AS predict, {', '.join(f'max(p) FILTER (c = {k}) AS p_{k}' for k in range(CLASSES))} FROM so{tag} JOIN fo USING (case_id) GROUP BY so{tag}.k, case_id)"""


_FO = f"""{LONG}, fo AS (SELECT vec_id AS case_id, CAST(label AS BIGINT) AS label, CAST(ntile(5) OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS fold FROM embeddings),
ks AS (SELECT CAST(unnest(range(5)) AS INT) AS k),
pr AS (SELECT k, label, ln(count(*) / sum(count(*)) OVER (PARTITION BY k)) AS prior FROM fo JOIN ks ON fold <> k GROUP BY k, label)"""
_SD = f"{_FO}, {fold_cte()}"
_PR = f"{_SD}, pd AS (SELECT * FROM sd WHERE part = 'valid')"
for _kind in _TERM:
    register(f"ml_cv_bayes_{_kind}", lambda spark, d, m=f"bayes{_kind}": rounded(fold_table(spark, d, (m,))),
             f"WITH {_FO}, {fold_cte(_kind)} SELECT 'bayes{_kind}' AS model, fold, part, case_id, label, predict, {', '.join(f'{r6(c)} AS {c}' for c in _P)} FROM sd")


def report_cte(keys="", src="pd"):
    k = f"{keys}, " if keys else ""
    u = f"USING ({keys}, cls)" if keys else "USING (cls)"
    g = f" GROUP BY {keys}" if keys else ""
    return f"""su AS (SELECT {k}label AS cls, count(*) AS support, count(CASE WHEN label = predict THEN 1 END) AS hit FROM {src} GROUP BY ALL),
ca AS (SELECT {k}predict AS cls, count(*) AS called FROM {src} GROUP BY ALL),
pc AS (SELECT {k}cls, coalesce(support, 0) AS support, CASE WHEN coalesce(called, 0) = 0 THEN 0 ELSE coalesce(hit, 0) / called END AS precision,
       CASE WHEN coalesce(support, 0) = 0 THEN 0 ELSE hit / support END AS recall FROM su FULL JOIN ca {u}),
pf AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pc),
rep AS (SELECT {k}CAST(cls AS VARCHAR) AS class, precision, recall, f1, CAST(support AS BIGINT) AS support FROM pf UNION ALL
        SELECT {k}'avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM pf{g})"""


_REPC = f"class, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1"
register("ev_class_report", lambda spark, d: rounded(ev.class_report(predictions(spark, d))),
         f"WITH {_PR}, {report_cte()} SELECT {_REPC}, support FROM rep")
register("agg_fold_mean",
         lambda spark, d: rounded(ev.class_report(predictions(spark, d), ["fold"]).groupBy("class").agg(
             *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])),
         f"WITH {_PR}, {report_cte('fold')} SELECT class, {r6('avg(precision)')} AS precision, {r6('avg(recall)')} AS recall, {r6('avg(f1)')} AS f1 FROM rep GROUP BY class")
register("ev_confusion",
         lambda spark, d: rounded(ev.confusion(predictions(spark, d)).withColumn(
             "share", F.col("n") / F.sum("n").over(Window.partitionBy("label")))),
         f"WITH {_PR}, c AS (SELECT label, predict, count(*) AS n FROM pd GROUP BY ALL) SELECT *, {r6('n / sum(n) OVER (PARTITION BY label)')} AS share FROM c")
register("ev_accuracy", lambda spark, d: rounded(ev.accuracy(fold_table(spark, d), ["fold", "part"])),
         f"WITH {_PR} SELECT fold, part, {r6('avg(CASE WHEN label = predict THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM sd GROUP BY ALL")
register("agg_argmax_fold",
         lambda spark, d: learn.best_fold(ev.accuracy(predictions(spark, d), ["fold"])),
         f"""WITH {_PR}, a AS (SELECT fold, avg(CASE WHEN label = predict THEN 1.0 ELSE 0.0 END) AS accuracy FROM pd WHERE part = 'valid' GROUP BY fold)
SELECT fold FROM a ORDER BY accuracy DESC, fold DESC LIMIT 1""")
register("ev_sens_spec", lambda spark, d: rounded(ev.sensitivity_specificity(predictions(spark, d))),
         f"""WITH {_PR}, k AS (SELECT unnest(range(10)) AS cls) SELECT CAST(cls AS VARCHAR) AS class,
{r6('count(CASE WHEN label = cls AND predict = cls THEN 1 END) / count(CASE WHEN label = cls THEN 1 END)')} AS sensitivity,
{r6('count(CASE WHEN label <> cls AND predict <> cls THEN 1 END) / count(CASE WHEN label <> cls THEN 1 END)')} AS specificity FROM pd, k GROUP BY cls""")


def _samples(spark, d):
    p = predictions(spark, d)
    i = F.col("case_id").cast("string")
    return rounded(p.select(F.concat(F.lit("img"), i).alias("image"), F.concat(F.lit("mask"), i).alias("mask"), "label", "predict",
                            F.greatest(*_P).alias("p_predicted"), *_P,
                            (F.col("label") == F.col("predict")).cast("int").alias("correct")))


register("ev_samples", _samples,
         f"""WITH {_PR} SELECT 'img' || case_id AS image, 'mask' || case_id AS mask, label, predict, {r6('greatest(' + ', '.join(_P) + ')')} AS p_predicted,
{', '.join(f'{r6(c)} AS {c}' for c in _P)}, CAST(label = predict AS INT) AS correct FROM pd""")


_TWO = f"""{_SD}, {fold_cte('bernoulli', '2')}, tm AS (SELECT 'bayesgaussian' AS model, part, fold, label, predict FROM sd
UNION ALL SELECT 'bayesbernoulli', part, fold, label, predict FROM sd2)"""


def _compare(spark, d):
    a = ev.accuracy(fold_table(spark, d, ("bayesgaussian", "bayesbernoulli")), ["model", "part", "fold"]).groupBy("model", "part").agg(F.avg("accuracy").alias("a"))
    return rounded(a.groupBy("model").pivot("part", ["train", "valid"]).agg(F.first("a")))


register("ev_model_compare", _compare,
         f"""WITH {_TWO}, a AS (SELECT model, part, fold, avg(CASE WHEN label = predict THEN 1.0 ELSE 0.0 END) AS a FROM tm GROUP BY ALL)
SELECT model, {r6("avg(a) FILTER (part = 'train')")} AS train, {r6("avg(a) FILTER (part = 'valid')")} AS valid FROM a GROUP BY model""")


def class_scores(p, keys=("case_id",)):
    """One row per sample and class: score and hit."""
    arr = F.array(*[F.struct(F.lit(str(k)).alias("class"), F.col(f"p_{k}").alias("score"),
                             (F.col("label") == k).cast("int").alias("hit")) for k in range(CLASSES)])
    return p.select(*keys, F.explode(arr).alias("t")).select(*keys, "t.*")


def class_cte(src):
    return "cs AS (" + " UNION ALL ".join(f"SELECT case_id, part, '{k}' AS class, p_{k} AS score, CAST(label = {k} AS INT) AS hit FROM {src}" for k in range(CLASSES)) + ")"


def auc_sql(keys, src):
    return f"""rk AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS r FROM {src}),
au AS (SELECT {keys}, (sum(r) FILTER (hit = 1) - sum(hit) * (sum(hit) + 1) / 2.0) / (sum(hit) * sum(1 - hit)) AS auc FROM rk GROUP BY {keys})"""


register("ev_auc_compare", lambda spark, d: rounded(ev.auc(class_scores(fold_table(spark, d), ["case_id", "part"]), ["class", "part"])),
         f"WITH {_SD}, {class_cte('sd')}, {auc_sql('class, part', 'cs')} SELECT class, part, {r6('auc')} AS auc FROM au")


def _report_merge(spark, d):
    p = predictions(spark, d)
    a = ev.auc(class_scores(p), ["class"]).join(ev.sensitivity_specificity(p), "class")
    return rounded(a.join(ev.class_report(p), "class"))


register("jn_report_merge", _report_merge,
         f"""WITH {_PR}, {class_cte('pd')}, {auc_sql('class', 'cs')}, {report_cte()}, ss AS (SELECT CAST(cls AS VARCHAR) AS class,
count(CASE WHEN label = cls AND predict = cls THEN 1 END) / count(CASE WHEN label = cls THEN 1 END) AS sensitivity,
count(CASE WHEN label <> cls AND predict <> cls THEN 1 END) / count(CASE WHEN label <> cls THEN 1 END) AS specificity FROM pd, (SELECT unnest(range(10)) AS cls) GROUP BY cls)
SELECT {_REPC}, support, {r6('auc')} AS auc, {r6('sensitivity')} AS sensitivity, {r6('specificity')} AS specificity FROM rep JOIN au USING (class) JOIN ss USING (class)""")


def _prediction_json(spark, d):
    p = predictions(spark, d)
    per = F.array(*[F.array(F.lit(str(k)), F.format_string("%.4f", F.col(f"p_{k}") + 1e-9)) for k in range(CLASSES)])
    return p.select("case_id", F.to_json(F.struct(F.concat(F.lit("img"), F.col("case_id").cast("string")).alias("Image_Name"),
                                                  F.col("label").alias("Ground_Truth"), per.alias("Prediction"))).alias("doc"))


register("ev_prediction_json", _prediction_json,
         f"""WITH {_PR} SELECT case_id, '{{"Image_Name":"img' || case_id || '","Ground_Truth":' || label || ',"Prediction":[' ||
{" || ',' || ".join(f"""'["{k}","' || printf('%.4f', p_{k} + 1e-9) || '"]'""" for k in range(CLASSES))} || ']}}' AS doc FROM pd""")

# ---- ROC band of the fitted model -----------------------------------------------------------------------


def _fold_band(spark, d):
    """Mean ROC over the folds of each class, with its spread."""
    cs = class_scores(predictions(spark, d), ["fold"])
    return rounded(ev.mean_roc(cs, "fold", ["class"]))


register("ev_fold_roc_band", _fold_band)
