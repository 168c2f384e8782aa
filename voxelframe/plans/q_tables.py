"""Projections, predicates, joins, aggregates, ordered computations, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxelframe.functions import names
from voxelframe.operators import cooccurrence as co
from voxelframe.operators import grid, ordering, tabular, weighted
from voxelframe.operators import evaluate as ev
from voxelframe.plans import sql
from voxelframe.plans.catalog import r6, register
from voxelframe.plans.q_sources import label_docs
from voxelframe.plans.q_texture import rounded
from voxelframe.sources import readers
from voxelframe.sources import tables as T


def tab(name):
    return lambda spark, d: T.table(spark, d, name)


def keyed_features(spark, d, n=4):
    """image, mask, label and a few feature columns of two classes."""
    e = T.table(spark, d, "embeddings")
    i = F.col("vec_id").cast("string")
    cls = ("firstorder_Mean", "glcm_Contrast", "gldm_Entropy", "clinical_Age")
    return e.select(F.concat(F.lit("img"), i).alias("image"), F.concat(F.lit("mask"), i).alias("mask"),
                    F.col("label").cast("long").alias("label"),
                    *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(cls[:n])])


_F4 = ["firstorder_Mean", "glcm_Contrast", "gldm_Entropy", "clinical_Age"]
_S4 = ", ".join(f"{r6(f'embedding[{k + 1}]::DOUBLE')} AS \"{c}\"" for k, c in enumerate(_F4))
_IM = "'img' || vec_id AS image, 'mask' || vec_id AS mask"

# ---- projections --------------------------------------------------------------------------------------

register("prj_feature_columns",
         lambda spark, d: rounded(keyed_features(spark, d).select(*tabular.feature_columns(keyed_features(spark, d)))),
         f"SELECT {_S4} FROM embeddings")
register("prj_choose_feature",
         lambda spark, d: rounded(tabular.choose_features(keyed_features(spark, d), tabular.BUILT_IN)),
         f"SELECT {_IM}, {r6('embedding[1]::DOUBLE')} AS \"firstorder_Mean\", {r6('embedding[2]::DOUBLE')} AS \"glcm_Contrast\" FROM embeddings")
register("prj_reorder", lambda spark, d: rounded(tabular.reorder(keyed_features(spark, d), ["label", "mask"])),
         f"SELECT CAST(label AS BIGINT) AS label, {_IM}, {_S4} FROM embeddings")


def _part_names(spark, d):
    return T.table(spark, d, "part").select("p_partkey", F.concat_ws(
        "_", F.lower("p_type"), F.regexp_replace("p_brand", "#", ""), F.regexp_replace("p_name", " ", "_")).alias("name"))


_PN = "(SELECT p_partkey, lower(p_type) || '_' || replace(p_brand, '#', '') || '_' || replace(p_name, ' ', '_') AS name FROM part)"
register("prj_rotate_name", lambda spark, d: _part_names(spark, d).select("p_partkey", names.rotate(F.col("name")).alias("name")),
         f"SELECT p_partkey, substr(name, strpos(name, '_') + 1) || '_' || split_part(name, '_', 1) AS name FROM {_PN}")
register("prj_group_path", lambda spark, d: _part_names(spark, d).select("p_partkey", names.group_path(F.col("name")).alias("path")),
         f"SELECT p_partkey, 'radiomics/' || split_part(name, '_', 1) || '/' || split_part(name, '_', 2) AS path FROM {_PN}")


def _param_names(spark, d):
    p = T.table(spark, d, "part")
    v = F.concat(F.lit("suffix_origin_nd_"), F.when(F.col("p_size") % 2 == 0, "True").otherwise("False"),
                 F.lit("_inverse_False_percent_"), F.col("p_size").cast("string"))
    dist = F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 3)
    return p.select("p_partkey", names.parameterised("glcm", "Dmn", F.col("p_size"), dist, v).alias("name"))


register("prj_param_name", _param_names,
         """SELECT p_partkey, 'glcm_Dmn_b_' || p_size || CASE WHEN p_size % 3 <> 0 THEN '_d_' || (p_size % 3) ELSE '' END || '_f_origin_nd_' ||
CASE WHEN p_size % 2 = 0 THEN '1' ELSE '0' END || '_inv_0_p_' || p_size AS name FROM part""")


def _tag(spark, d):
    o = T.table(spark, d, "orders")
    t = F.when(F.col("o_orderstatus") == "F", "training").when(F.col("o_orderstatus") == "O", "validation").otherwise("testing")
    return o.select("o_orderkey", t.alias("tag")).withColumn(
        "dataset", F.when(F.col("tag").isin("training", "validation"), 0).when(F.col("tag") == "testing", 1))


register("prj_tag_recode", _tag,
         """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'training' WHEN 'O' THEN 'validation' ELSE 'testing' END AS tag,
CASE WHEN o_orderstatus IN ('F', 'O') THEN 0 ELSE 1 END AS dataset FROM orders""")


def selection_result(spark, d):
    """feature x filter flags from the mean and spread of each feature."""
    s = T.features_long(spark, d).groupBy("feature").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    return s.select("feature", F.when(F.col("v") > 0.0155, 1).otherwise(0).alias("variance"),
                    F.when(F.abs("m") > 0.004, 1).otherwise(0).alias("k_best"), F.lit(None).cast("int").alias("lasso"))


_SEL = f"""{T.SQL_LONG}, sr AS (SELECT feature, CASE WHEN var_pop(value) > 0.0155 THEN 1 ELSE 0 END AS variance,
CASE WHEN abs(avg(value)) > 0.004 THEN 1 ELSE 0 END AS k_best FROM fl GROUP BY feature)"""


def _drop_unrun(spark, d):
    """A filter that did not run left only nulls."""
    r = selection_result(spark, d)
    flags = [c for c in r.columns if c != "feature"]
    ran = r.agg(*[F.count(c).alias(c) for c in flags]).first()
    return r.select("feature", *[c for c in flags if ran[c] > 0])


register("prj_drop_unrun", _drop_unrun, f"WITH {_SEL} SELECT * FROM sr")
register("prj_label_map",
         lambda spark, d: T.table(spark, d, "customer").select("c_custkey", F.element_at(F.create_map(
             *[F.lit(x) for kv in (("BUILDING", 1), ("AUTOMOBILE", 2), ("MACHINERY", 3)) for x in kv]), F.col("c_mktsegment")).alias("code")),
         "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 WHEN 'MACHINERY' THEN 3 END AS code FROM customer")

# ---- predicates -----------------------------------------------------------------------------------------


def index(spark, d):
    i = F.col("o_orderkey")
    return _tag(spark, d).join(T.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey").select(
        i.alias("id"), F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("mask"), "tag",
        F.when(i % 4 == 0, 0).otherwise(1).alias("flag"), "o_totalprice")


register("flt_flag", lambda spark, d: index(spark, d).where("flag = 1").select("id", "mask"),
         "SELECT o_orderkey AS id, 'm' || o_custkey AS mask FROM orders WHERE o_orderkey % 4 <> 0")
register("flt_row_id", lambda spark, d: index(spark, d).where(F.col("id").cast("string") == "42").select("id", "mask", "tag"),
         """SELECT o_orderkey AS id, 'm' || o_custkey AS mask, CASE o_orderstatus WHEN 'F' THEN 'training' WHEN 'O' THEN 'validation' ELSE 'testing' END AS tag
FROM orders WHERE CAST(o_orderkey AS VARCHAR) = '42'""")


def _catalog(spark, d):
    """Columns are chosen by a catalog of intent, activity and type."""
    long = T.features_long(spark, d)
    k = F.substring("feature", 2, 2).cast("int")
    cat = long.select("feature").distinct().select(
        "feature", F.when(k % 7 == 0, "out").otherwise("in").alias("intent"), (k % 3 != 0).alias("active"),
        F.when(k % 5 == 0, "category").otherwise("number").alias("type"))
    return rounded(long.join(cat.where("intent = 'in' AND active AND type = 'number'").select("feature"), "feature", "left_semi")
                   .select("case_id", "feature", "value"))


register("flt_catalog", _catalog,
         f"""WITH {T.SQL_LONG}, k AS (SELECT *, CAST(substr(feature, 2) AS INT) AS k FROM fl)
SELECT case_id, feature, {r6('value')} AS value FROM k WHERE k % 7 <> 0 AND k % 3 <> 0 AND k % 5 <> 0""")
register("flt_dropna_target",
         lambda spark, d: T.table(spark, d, "documents").join(T.table(spark, d, "labels"), "doc_id", "left").select(
             "doc_id", "quality").na.drop(),
         "SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
register("flt_dataset_split",
         lambda spark, d: T.targets(spark, d).join(T.tags(spark, d), "case_id").where("dataset = 0"),
         "SELECT vec_id AS case_id, CAST(label AS BIGINT) AS label, CAST(0 AS BIGINT) AS dataset FROM embeddings WHERE vec_id % 5 <> 0")


def _label_sets(spark, d):
    li = T.table(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("ids"))  # at most three flags


register("flt_label_cover",
         lambda spark, d: _label_sets(spark, d).where(F.size(F.array_except(F.array(F.lit("A"), F.lit("N")), "ids")) == 0).select("l_orderkey"),
         "SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 2")
register("flt_active_all",
         lambda spark, d: T.features_long(spark, d).select("feature").distinct().unionByName(
             T.table(spark, d, "nation").select(F.col("n_name").alias("feature"))).join(
             selection_result(spark, d), "feature", "left").select("feature", tabular.all_true(None, ["variance", "k_best"]).alias("active")),
         f"""WITH {_SEL}, c AS (SELECT DISTINCT feature FROM fl UNION ALL SELECT n_name FROM nation)
SELECT c.feature, coalesce(least(variance, k_best) = 1, false) AS active FROM c LEFT JOIN sr USING (feature)""")
register("flt_first_row",
         lambda spark, d: rounded(keyed_features(spark, d).orderBy("mask").limit(1)),
         f"SELECT {_IM}, CAST(label AS BIGINT) AS label, {_S4} FROM embeddings ORDER BY 'mask' || vec_id LIMIT 1")

# ---- joins ------------------------------------------------------------------------------------------------

register("jn_feature_target",
         lambda spark, d: rounded(T.features(spark, d).select("case_id", "f00").join(T.targets(spark, d), "case_id")),
         f"SELECT vec_id AS case_id, {r6('embedding[1]::DOUBLE')} AS f00, CAST(label AS BIGINT) AS label FROM embeddings")
register("jn_natural_tags",
         lambda spark, d: rounded(tabular.natural(keyed_features(spark, d, 1), keyed_features(spark, d, 0).where("label < 5").select(
             "mask", "label", F.lit(1).alias("dataset")))),
         f"SELECT {_IM}, CAST(label AS BIGINT) AS label, {r6('embedding[1]::DOUBLE')} AS \"firstorder_Mean\", 1 AS dataset FROM embeddings WHERE label < 5")


def _semi_train(spark, d):
    t = T.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("label"), (F.col("o_orderkey") % 3).alias("dataset"))
    return t.join(t.where("dataset = 0").select("label").distinct(), "label", "left_semi")


register("jn_semi_train_labels", _semi_train,
         """SELECT o_orderkey, o_custkey AS label, o_orderkey % 3 AS dataset FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)""")


def _index_features(spark, d):
    f = T.table(spark, d, "customer").where("c_custkey % 3 <> 0").select(
        F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("mask"), "c_acctbal")
    return index(spark, d).select("id", "mask").join(f, "mask", "left")


register("jn_left_index_features", _index_features,
         "SELECT o_orderkey AS id, 'm' || o_custkey AS mask, c_acctbal FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 <> 0")


def _last_wins(spark, d):
    left = T.table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), "c_name")
    right = T.table(spark, d, "orders").select(F.col("o_custkey").alias("pid"), F.col("o_orderkey").alias("pos"), "o_orderpriority")
    return tabular.last_wins(left, right, "pid", "pos")


register("jn_left_last_wins", _last_wins,
         """SELECT CAST(c_custkey AS VARCHAR) AS pid, c_name, o_orderpriority FROM customer
LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
register("jn_positional",
         lambda spark, d: T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), "s_name").join(
             T.table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), "p_name"), "row_id"),
         "SELECT s_suppkey AS row_id, s_name, p_name FROM supplier JOIN part ON p_partkey = s_suppkey")


def _lookup(spark, d):
    known = T.table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("idx")).groupBy("s_nationkey").agg(F.min("idx").alias("idx"))
    c = T.table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") + 10).alias("nk"))
    return c.join(known, F.col("nk") == F.col("s_nationkey"), "left").select("c_custkey", F.coalesce("idx", F.lit(-1)).cast("long").alias("idx"))


register("jn_lookup_default", _lookup,
         """SELECT c_custkey, CAST(coalesce(idx, -1) AS BIGINT) AS idx FROM customer LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS idx FROM supplier GROUP BY 1)
ON s_nationkey = c_nationkey + 10""")


def _label_names(spark, d):
    """Annotations (item, set, label) to one column per label set."""
    defs = readers.label_definitions(label_docs(spark, d))
    items = T.table(spark, d, "customer").join(T.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_regionkey").cast("string").alias("labelSetId"), F.col("n_nationkey").cast("string").alias("labelId"))
    j = items.join(defs, ["labelSetId", "labelId"])
    sets = tabular.classes(defs, "set_name")
    wide = j.groupBy("c_custkey").pivot("set_name", sets).agg(F.first("label_name"))
    return wide.withColumnsRenamed({s: s.replace(" ", "_") for s in sets})


register("jn_label_names", _label_names,
         """SELECT c_custkey, CASE WHEN r_name = 'AFRICA' THEN n_name END AS "AFRICA", CASE WHEN r_name = 'AMERICA' THEN n_name END AS "AMERICA",
CASE WHEN r_name = 'ASIA' THEN n_name END AS "ASIA", CASE WHEN r_name = 'EUROPE' THEN n_name END AS "EUROPE", CASE WHEN r_name = 'MIDDLE EAST' THEN n_name END AS "MIDDLE_EAST"
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
register("jn_semi_region",
         lambda spark, d: T.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("region")).join(
             T.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("region")), "region", "left_semi"),
         "SELECT o_orderkey, o_custkey AS region FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")


def _levels(spark, d):
    return grid.discretise_many(grid.roi(T.voxels3d_roi(spark, d)), (8, 32)).select("case_id", "bin_count", "g").distinct()


def _empty_levels(spark, d):
    lv = _levels(spark, d)
    every = lv.groupBy("case_id", "bin_count").agg(F.max("g").alias("ng")).select(
        "case_id", "bin_count", F.explode(F.sequence(F.lit(1), F.col("ng"))).alias("g"))
    return every.join(lv, ["case_id", "bin_count", "g"], "left_anti")


_LV = sql.lev_cte((8, 32), T.SQL_VOX_ROI)
register("jn_anti_empty_levels", _empty_levels,
         f"""WITH {_LV}, e AS (SELECT case_id, bin_count, CAST(unnest(range(1, max(g) + 1)) AS INT) AS g FROM lev GROUP BY case_id, bin_count)
SELECT * FROM e ANTI JOIN lev USING (case_id, bin_count, g)""")
register("set_distinct_levels", _levels, f"WITH {_LV} SELECT DISTINCT case_id, bin_count, g FROM lev")


def _neighbour(spark, d):
    cells = grid.roi(T.voxels3d_roi(spark, d))
    p = grid.neighbour_pairs(cells.select("case_id", "z", "y", "x", "v"), grid.offsets((1, 2)), carry=("v",))
    return rounded(p.select("case_id", "dist", "angle", "z", "y", "x", "v", "v2"))


register("jn_neighbour", _neighbour,
         f"""WITH {T.SQL_VOX_ROI}, {sql.off_cte((1, 2))}, r AS (SELECT * FROM vox WHERE m = 1)
SELECT a.case_id, dist, angle, a.z, a.y, a.x, {r6('a.v')} AS v, {r6('b.v')} AS v2 FROM (SELECT * FROM r, off) a
JOIN r b ON b.case_id = a.case_id AND b.z = a.z + a.dz AND b.y = a.y + a.dy AND b.x = a.x + a.dx""")

# ---- aggregates --------------------------------------------------------------------------------------------


def _missing_long(spark, d):
    """Event values by type, some missing: (case_id, feature, value)."""
    e = T.table(spark, d, "events")
    return e.select(F.col("event_id").alias("case_id"), F.col("event_type").alias("feature"),
                    F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"))


_ML = "SELECT event_id AS case_id, event_type AS feature, CASE WHEN event_id % 10 <> 0 THEN value END AS value FROM events"


def column_stats(long):
    """Statistics with the missing flag taken before imputation."""
    miss = F.max(F.when(F.col("value").isNull() | F.isnan("value"), 1).otherwise(0))
    before = long.groupBy("feature").agg(miss.alias("missing"))
    s = tabular.impute(long).groupBy("feature").agg(F.max("value").alias("max"), F.min("value").alias("min"),
                                                    F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return s.join(before, "feature").select(F.col("feature").alias("name"), F.lit("Real").alias("type"), "missing", "max", "min", "mean", "std")


register("agg_column_stats", lambda spark, d: rounded(column_stats(_missing_long(spark, d))),
         f"""WITH l AS ({_ML}), m AS (SELECT feature, avg(value) AS mu, max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS missing FROM l GROUP BY feature),
i AS (SELECT l.feature, coalesce(value, mu, 0) AS v, missing FROM l JOIN m USING (feature))
SELECT feature AS name, 'Real' AS type, any_value(missing) AS missing, {r6('max(v)')} AS max, {r6('min(v)')} AS min, {r6('avg(v)')} AS mean, {r6('stddev_pop(v)')} AS std FROM i GROUP BY feature""")


def _value_probs(spark, d):
    vw = weighted.collapse(grid.roi(T.voxels3d(spark, d)).withColumn("v", F.round("v", 1)), ["case_id"])
    return rounded(weighted._probabilities(vw, ["case_id"]).select("case_id", F.col("v").alias("value"), "w", F.col("q").alias("p")))


register("agg_value_probs", _value_probs,
         f"""WITH {T.SQL_VOX}, c AS (SELECT case_id, round(v, 1) + 0.0 AS value, count(*) AS w FROM vox GROUP BY ALL)
SELECT case_id, {r6('value')} AS value, w, {r6('w / sum(w) OVER (PARTITION BY case_id)')} AS p FROM c""")
register("agg_count_distinct", lambda spark, d: T.targets(spark, d).agg(F.countDistinct("label").alias("classes")),
         "SELECT count(DISTINCT label) AS classes FROM embeddings")


def _before_after(spark, d):
    r = selection_result(spark, d)
    cls = F.when(F.substring("feature", 2, 1) < "3", F.concat(F.lit("class"), F.substring("feature", 2, 1))).otherwise("custom")
    return r.groupBy(cls.alias("name")).agg(F.count(F.lit(1)).alias("before"), F.sum(F.col("variance") * F.col("k_best")).alias("after"))


register("agg_before_after", _before_after,
         f"""WITH {_SEL} SELECT CASE WHEN substr(feature, 2, 1) < '3' THEN 'class' || substr(feature, 2, 1) ELSE 'custom' END AS name, count(*) AS before,
CAST(sum(variance * k_best) AS BIGINT) AS after FROM sr GROUP BY 1""")
register("agg_selected_counts",
         lambda spark, d: selection_result(spark, d).agg(F.sum("variance").alias("variance"), F.sum("k_best").alias("k_best")),
         f"WITH {_SEL} SELECT CAST(sum(variance) AS BIGINT) AS variance, CAST(sum(k_best) AS BIGINT) AS k_best FROM sr")


def corr_features(spark, d):
    return tabular.correlations(T.features(spark, d), T.feature_names())


_A64 = ", ".join(f"embedding[{k + 1}]::DOUBLE AS f{k:02d}" for k in range(64))
register("agg_corr_matrix", lambda spark, d: rounded(corr_features(spark, d)),
         f"WITH {T.SQL_LONG} SELECT a.feature AS a, b.feature AS b, {r6('corr(a.value, b.value)')} AS r FROM fl a JOIN fl b USING (case_id) GROUP BY ALL")

# ---- ordered computations -----------------------------------------------------------------------------------


def scores(spark, d):
    return T.table(spark, d, "documents").join(T.table(spark, d, "labels"), "doc_id").select(
        F.col("lang").alias("class"), "doc_id", F.col("n_chars").alias("score"), F.col("quality").alias("hit"))


_SC = "sc AS (SELECT lang AS class, doc_id, n_chars AS score, quality AS hit FROM documents JOIN labels USING (doc_id))"
_RO = f"""{_SC}, tg AS (SELECT class, score::DOUBLE AS threshold, sum(hit) AS pos, sum(1 - hit) AS neg FROM sc GROUP BY class, score),
cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY class) AS p, sum(neg) OVER (PARTITION BY class) AS n
       FROM tg WINDOW w AS (PARTITION BY class ORDER BY threshold DESC)),
rc AS (SELECT class, threshold, CASE WHEN n = 0 THEN 0 ELSE fp / n END AS fpr, CASE WHEN p = 0 THEN 0 ELSE tp / p END AS tpr FROM cu
       UNION ALL SELECT DISTINCT class, 1.0, 0, 0 FROM cu)"""
register("win_roc_curve", lambda spark, d: rounded(ev.roc_curve(scores(spark, d), ["class"])),
         f"WITH {_RO} SELECT class, {r6('threshold')} AS threshold, {r6('fpr')} AS fpr, {r6('tpr')} AS tpr FROM rc")
register("win_auc", lambda spark, d: rounded(ev.auc(scores(spark, d), ["class"])),
         f"""WITH {_RO}, lg AS (SELECT *, lag(fpr) OVER w AS f0, lag(tpr) OVER w AS t0 FROM rc WINDOW w AS (PARTITION BY class ORDER BY fpr, tpr))
SELECT class, {r6('coalesce(sum((fpr - f0) * (tpr + t0) / 2), 0)')} AS auc FROM lg GROUP BY class""")


def fold_scores(spark, d):
    return scores(spark, d).withColumn("fold", F.col("doc_id") % 3)


_MR = _RO.replace("lang AS class", "CAST(doc_id % 3 AS BIGINT) AS class")
register("win_mean_roc", lambda spark, d: rounded(ev.mean_roc(fold_scores(spark, d), "fold")),
         f"""WITH {_MR}, gr AS (SELECT DISTINCT class, unnest(range(0, 100)) AS g FROM rc),
lo AS (SELECT gr.class, g, max(struct_pack(f := fpr, t := tpr)) AS a FROM gr JOIN rc ON rc.class = gr.class AND fpr <= g / 99.0 GROUP BY ALL),
hi AS (SELECT gr.class, g, min(struct_pack(f := fpr, t := tpr)) AS b FROM gr JOIN rc ON rc.class = gr.class AND fpr > g / 99.0 GROUP BY ALL),
tt AS (SELECT lo.class, lo.g, CASE WHEN lo.g = 0 THEN 0 WHEN b IS NULL THEN a.t ELSE a.t + (b.t - a.t) * (lo.g / 99.0 - a.f) / (b.f - a.f) END AS t
       FROM lo LEFT JOIN hi ON hi.class = lo.class AND hi.g = lo.g),
mm AS (SELECT g, CASE WHEN g = 99 THEN 1.0 ELSE avg(t) END AS tpr, stddev_pop(t) AS sd FROM tt GROUP BY g)
SELECT CAST(g AS INT) AS g, {r6('g / 99.0')} AS fpr, {r6('tpr')} AS tpr, {r6('sd')} AS sd, {r6('greatest(tpr - sd, 0)')} AS lower, {r6('least(tpr + sd, 1)')} AS upper FROM mm""")
register("win_stratified_folds",
         lambda spark, d: ordering.stratified_folds(T.targets(spark, d), "label", "case_id", 5),
         "SELECT vec_id AS case_id, CAST(label AS BIGINT) AS label, CAST(ntile(5) OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS fold FROM embeddings")


def _with_row(df, row):
    """Every row beside a one-row aggregate."""
    one = F.broadcast(row.withColumn("_one", F.lit(1)))
    return df.withColumn("_one", F.lit(1)).join(one, "_one").drop("_one")


def qcut(df, col, parts):
    """Equal-size bins: a value's bin is the number of inner percentile edges below it, from 0."""
    vw = weighted.ranked(weighted.collapse(df.select(F.lit(0).alias("k"), F.col(col).alias("v")), ["k"]), ["k"])
    edges = vw.groupBy("k").agg(*[weighted.quantile(i / parts).alias(f"e{i}") for i in range(1, parts)]).drop("k")
    code = sum((F.when(F.col(col) > F.col(f"e{i}"), 1).otherwise(0) for i in range(2, parts)),
               F.when(F.col(col) > F.col("e1"), 1).otherwise(0))
    return _with_row(df, edges).withColumn("code", code).drop(*[f"e{i}" for i in range(1, parts)])


def cut(df, col, parts):
    """Equal-width bins, right-closed, from 0."""
    rng = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    x = F.ceil((F.col(col) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / parts)) - 1
    return _with_row(df, rng).withColumn("code", F.greatest(x, F.lit(0)).cast("int")).drop("lo", "hi")


def _price(spark, d):
    return T.table(spark, d, "orders").select("o_orderkey", "o_totalprice")


register("win_qcut", lambda spark, d: qcut(_price(spark, d), "o_totalprice", 4),
         """WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS e FROM orders)
SELECT o_orderkey, o_totalprice, CAST(len(list_filter(e, lambda x: o_totalprice > x)) AS INT) AS code FROM orders, q""")
register("win_cut", lambda spark, d: cut(_price(spark, d), "o_totalprice", 5),
         """WITH q AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT o_orderkey, o_totalprice, CAST(greatest(ceil((o_totalprice - lo) / ((hi - lo) / 5)) - 1, 0) AS INT) AS code FROM orders, q""")

# ---- order and sets -------------------------------------------------------------------------------------------

register("srt_classes", lambda spark, d: T.table(spark, d, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment"),
         "SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1")
register("srt_seeded_shuffle", lambda spark, d: T.targets(spark, d).orderBy(F.xxhash64("case_id", F.lit(42))))
register("set_union_by_name",
         lambda spark, d: T.table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")).unionByName(
             T.table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg")), allowMissingColumns=True),
         "SELECT s_name AS name, s_acctbal AS bal, NULL::VARCHAR AS seg FROM supplier UNION ALL SELECT c_name, NULL, c_mktsegment FROM customer")
register("set_except",
         lambda spark, d: T.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(
             T.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))),
         "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
register("set_intersect",
         lambda spark, d: T.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(
             T.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))),
         "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")


def _transpose(spark, d):
    orders = T.table(spark, d, "orders")
    status, pri = tabular.classes(orders, "o_orderstatus"), tabular.classes(orders, "o_orderpriority")
    c = orders.groupBy("o_orderpriority").pivot("o_orderstatus", status).count()
    long = c.unpivot("o_orderpriority", status, "status", "n")
    out = long.groupBy("status").pivot("o_orderpriority", pri).agg(F.first("n"))
    return out.select("status", *[F.coalesce(F.col(f"`{p}`"), F.lit(0)).alias(f"p{p[0]}") for p in pri])


register("set_transpose", _transpose,
         "SELECT o_orderstatus AS status, " + ", ".join(f"count(CASE WHEN o_orderpriority LIKE '{k}%' THEN 1 END) AS p{k}" for k in range(1, 6)) +
         " FROM orders GROUP BY 1")

# ---- scalar functions --------------------------------------------------------------------------------------------


def _fn_string(spark, d):
    p = T.table(spark, d, "part")
    s = F.split("p_name", " ")
    return p.select("p_partkey", F.concat_ws("_", s).alias("joined"), F.regexp_replace("p_brand", "#", "-").alias("replaced"),
                    F.col("p_type").startswith("ECONOMY").alias("economy"),
                    F.substring_index(F.concat(F.lit("/a/b/"), "p_name"), "/", -1).alias("base"),
                    F.regexp_replace(F.concat(F.lit("/a/b/"), "p_name"), "/[^/]*$", "").alias("dir"),
                    F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"),
                    F.format_string("%s-%d", "p_brand", "p_size").alias("formatted"),
                    F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1000)).alias("capital"))


register("fn_string", _fn_string,
         """SELECT p_partkey, replace(p_name, ' ', '_') AS joined, replace(p_brand, '#', '-') AS replaced, starts_with(p_type, 'ECONOMY') AS economy, p_name AS base,
'/a/b' AS dir, trim(p_name) AS trimmed, p_brand || '-' || p_size AS formatted, upper(p_name[1]) || substr(p_name, 2) AS capital FROM part""")


def _fn_math(spark, d):
    x = F.col("l_extendedprice") / 1000.0
    return rounded(T.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.log(x).alias("ln"), F.log2(x).alias("log2"), F.exp(x / 50.0).alias("exp"), F.sqrt(x).alias("sqrt"),
        F.pow(x, F.lit(1.5)).alias("pow"), F.abs(x - 40.0).alias("abs"), F.floor(x).cast("long").alias("floor"), F.ceil(x).cast("long").alias("ceil"),
        F.pmod(F.col("l_quantity"), F.lit(7.0)).alias("mod"), F.round(F.round(x / 100.0 + 1e-9, 3) * 100.0, 6).alias("pct")))


register("fn_math", _fn_math,
         f"""WITH l AS (SELECT *, l_extendedprice / 1000.0 AS x FROM lineitem) SELECT l_orderkey, l_linenumber, {r6('ln(x)')} AS ln, {r6('log2(x)')} AS log2,
{r6('exp(x / 50)')} AS exp, {r6('sqrt(x)')} AS sqrt, {r6('pow(x, 1.5)')} AS pow, {r6('abs(x - 40)')} AS abs, CAST(floor(x) AS BIGINT) AS floor, CAST(ceil(x) AS BIGINT) AS ceil,
{r6('l_quantity % 7')} AS mod, {r6('round(round(x / 100.0 + 1e-9, 3) * 100, 6)')} AS pct FROM l""")


def _fn_nan(spark, d):
    e = T.table(spark, d, "events")
    v = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    e = e.select("event_id", "event_type", v.alias("v"))
    bad = F.isnan("v") | (F.abs("v") == float("inf"))
    mean = e.groupBy("event_type").agg(F.avg(F.when(~bad, F.col("v"))).alias("nanmean"))
    return rounded(e.join(mean, "event_type").select("event_id", F.when(bad, 0.0).otherwise(F.col("v")).alias("zeroed"),
                                                     F.when(bad, F.col("nanmean")).otherwise(F.col("v")).alias("filled")))


register("fn_nan", _fn_nan,
         f"""WITH e AS (SELECT *, event_id % 5 = 0 OR event_id % 7 = 0 AS bad FROM events), m AS (SELECT event_type, avg(value) AS mu FROM e WHERE NOT bad GROUP BY 1)
SELECT event_id, {r6('CASE WHEN bad THEN 0 ELSE value END')} AS zeroed, {r6('CASE WHEN bad THEN mu ELSE value END')} AS filled FROM e JOIN m USING (event_type)""")
register("fn_cast",
         lambda spark, d: T.table(spark, d, "part").select(
             "p_partkey", F.col("p_size").cast("string").alias("s"), F.expr("try_cast(substr(p_brand, 7) AS INT)").alias("i"),
             F.col("p_size").cast("double").alias("f"), F.expr("try_cast(p_name AS INT)").alias("bad")),
         """SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, TRY_CAST(substr(p_brand, 7) AS INT) AS i, CAST(p_size AS DOUBLE) AS f, TRY_CAST(p_name AS INT) AS bad FROM part""")


def _fn_array_map(spark, d):
    e = T.table(spark, d, "embeddings")
    vals = F.transform("embedding", lambda v: v.cast("double"))
    m = F.map_from_arrays(F.array(*[F.lit(n) for n in T.feature_names()]), vals)
    inv = F.map_from_entries(F.transform(F.map_entries(F.map_from_arrays(
        F.array(F.lit("n"), F.lit("l")), F.array(F.col("vec_id"), F.col("label").cast("long") + 100000))), lambda x: F.struct(x["value"], x["key"])))
    return rounded(e.select("vec_id", F.element_at(m, "f02").alias("c"), F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v).alias("total"), F.element_at(inv, F.col("vec_id")).alias("inv"),
                            (F.array_position(vals, F.array_max(vals)) - 1).cast("int").alias("argmax")))


register("fn_array_map", _fn_array_map,
         f"SELECT vec_id, {r6('embedding[3]::DOUBLE')} AS c, {r6('list_sum(embedding::DOUBLE[])')} AS total, 'n' AS inv, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS argmax FROM embeddings")
register("fn_json",
         lambda spark, d: T.table(spark, d, "events").select(
             "event_id", F.from_json("props", "k INT")["k"].alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("doc")),
         """SELECT event_id, CAST(props::JSON->>'k' AS INT) AS k, CAST(json_object('event_id', event_id, 'event_type', event_type) AS VARCHAR) AS doc FROM events""")
