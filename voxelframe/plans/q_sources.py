"""Sources and sinks. Files are written by Spark from the given tables into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.plans.catalog import r6, register
from voxelframe.plans.q_texture import rounded
from voxelframe.session import scratch_path
from voxelframe.sources import readers, sinks
from voxelframe.sources import tables as T


def _csv(spark, df, name):
    path = scratch_path(spark, name)
    sinks.write_csv(df, path)
    return path


def case_list(spark, d):
    i = F.col("vec_id").cast("string")
    return T.table(spark, d, "embeddings").select(F.concat(F.lit("img_"), i, F.lit(".nii")).alias("image"),
                                                  F.concat(F.lit("mask_"), i, F.lit(".nii")).alias("mask"))


register("src_cases", lambda spark, d: readers.cases(spark, _csv(spark, case_list(spark, d), "cases")),
         "SELECT 'img_' || vec_id || '.nii' AS image, 'mask_' || vec_id || '.nii' AS mask FROM embeddings")


def _batch(spark, d):
    i = F.col("c_custkey")
    return T.table(spark, d, "customer").select(
        F.when(i % 11 != 0, F.concat(F.when(i % 3 == 0, F.lit("/abs/")).otherwise(F.lit("")), F.lit("i"), i.cast("string"))).alias("Image"),
        F.when(i % 7 != 0, F.concat(F.lit("m"), i.cast("string"))).alias("Mask"),
        F.when(i % 5 == 0, F.lit("x1")).when(i % 5 != 1, (i % 5).cast("string")).alias("Label"),
        F.when(i % 2 == 0, (i % 4).cast("string")).alias("Label_channel"))


_IMG = "CASE WHEN c_custkey % 3 = 0 THEN '/abs/i' || c_custkey ELSE '/data/i' || c_custkey END"
_BASE = "FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 <> 0"
_CH = "CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 4 AS INT) END AS Label_channel"
register("src_batch_cases",
         lambda spark, d: readers.batch_cases(spark, _csv(spark, _batch(spark, d), "batch"), "/data"),
         f"SELECT {_IMG} AS Image, '/data/m' || c_custkey AS Mask, CASE WHEN c_custkey % 5 > 1 THEN CAST(c_custkey % 5 AS INT) END AS Label, {_CH} {_BASE}")
register("src_batch_cases_legacy",
         lambda spark, d: readers.batch_cases(spark, _csv(spark, _batch(spark, d), "batch"), "/data", legacy=True),
         f"SELECT {_IMG} AS Image, '/data/m' || c_custkey AS Mask, CASE WHEN c_custkey % 5 > 1 THEN CAST(c_custkey % 5 AS INT) ELSE 1 END AS Label, {_CH} {_BASE}")

_FCOLS = T.feature_names()
_FSCHEMA = "case_id BIGINT, " + ", ".join(f"{c} DOUBLE" for c in _FCOLS)


def _feature_tables(spark, d):
    f = readers.feature_table(spark, _csv(spark, T.features(spark, d), "features"), _FSCHEMA)
    t = readers.feature_table(spark, _csv(spark, T.targets(spark, d), "targets"), "case_id BIGINT, label BIGINT")
    g = readers.feature_table(spark, _csv(spark, T.tags(spark, d), "tags"), "case_id BIGINT, dataset BIGINT")
    return rounded(f.join(t, "case_id").join(g, "case_id"))


_WIDE = ", ".join(f"{r6(f'embedding[{k + 1}]::DOUBLE')} AS {c}" for k, c in enumerate(_FCOLS))
register("src_feature_table", _feature_tables,
         f"SELECT vec_id AS case_id, {_WIDE}, CAST(label AS BIGINT) AS label, CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS dataset FROM embeddings")


def _json_docs(spark, d):
    """Clinical documents of at most 50 rows each."""
    c = T.table(spark, d, "customer").select(
        F.floor(F.col("c_custkey") / 50).alias("block"),
        F.struct("c_custkey", F.array(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("cells")).alias("r"))
    cols = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("clinical").alias("group"), F.lit(t).alias("type"), F.lit(i).alias("intent"))
                     for n, t, i in (("key", "number", "in"), ("name", "object", "in"), ("segment", "category", "out"))])
    docs = c.groupBy("block").agg(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["cells"]).alias("data"))
    path = scratch_path(spark, "clinical")
    docs.select(cols.alias("columns"), "data").write.mode("overwrite").json(path)
    return path


register("src_json_table", lambda spark, d: readers.json_table(spark, _json_docs(spark, d), lines=True).drop("doc"),
         """WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) - 1 AS INT) AS row FROM customer)
SELECT row, 'key' AS name, 'clinical' AS grp, 'number' AS type, 'in' AS intent, CAST(c_custkey AS VARCHAR) AS value FROM r
UNION ALL SELECT row, 'name', 'clinical', 'object', 'in', c_name FROM r
UNION ALL SELECT row, 'segment', 'clinical', 'category', 'out', c_mktsegment FROM r""")


def label_docs(spark, d):
    """One label-definition document per region; its labels are the nations."""
    n = T.table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(
        F.col("n_nationkey").cast("string").alias("labelId"), F.col("n_name").alias("name"))).alias("labels"))
    r = T.table(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    return r.select(F.to_json(F.array(F.struct(F.col("r_regionkey").cast("string").alias("labelSetId"),
                                               F.col("r_name").alias("name"), "labels"))).alias("doc"))


register("src_label_defs", lambda spark, d: readers.label_definitions(label_docs(spark, d)),
         """SELECT CAST(r_regionkey AS VARCHAR) AS "labelSetId", r_name AS set_name, CAST(n_nationkey AS VARCHAR) AS "labelId", n_name AS label_name
FROM region JOIN nation ON n_regionkey = r_regionkey""")


def _region_docs(spark, d):
    e = T.table(spark, d, "embeddings")
    part = lambda a: F.transform(F.slice(F.col("embedding"), a, 8), lambda v: F.array(
        F.round(v.cast("double") * 100, 3), F.round(v.cast("double") * 50, 3)))
    data = F.array(F.struct((F.col("vec_id") % 3).cast("int").alias("index"), part(1).alias("path")),
                   F.struct((F.col("vec_id") % 5).cast("int").alias("index"), part(9).alias("path")))
    return e.select(F.to_json(F.array(F.struct(F.col("vec_id").cast("string").alias("regionId"), data.alias("data")))).alias("doc"))


register("src_regions", lambda spark, d: rounded(readers.regions(_region_docs(spark, d)), 3),
         f"""WITH e AS (SELECT vec_id, unnest(embedding[1:16])::DOUBLE AS v, unnest(range(0, 16)) AS k FROM embeddings)
SELECT CAST(vec_id AS VARCHAR) AS "regionId", CAST(k // 8 AS INT) AS contour, CAST(CASE WHEN k < 8 THEN vec_id % 3 ELSE vec_id % 5 END AS INT) AS index,
CAST(k % 8 AS INT) AS ord, {r6('round(v * 100, 3)', 3)} AS px, {r6('round(v * 50, 3)', 3)} AS py FROM e""")


def _metadata(spark, d):
    c = T.table(spark, d, "customer").select("c_custkey", F.to_json(F.struct(
        F.col("c_nationkey").cast("string").alias("age"), F.col("c_mktsegment").alias("modality"),
        F.col("c_name").alias("patientId"), F.lit("x").alias("scanner"),
        F.when(F.col("c_custkey") % 2 == 0, "F").alias("sex"))).alias("doc"))
    return c.select("c_custkey", F.explode(readers.metadata(c)).alias("key", "value"))


register("src_metadata_attrs", _metadata,
         """SELECT c_custkey, 'Age' AS key, CAST(c_nationkey AS VARCHAR) AS value FROM customer UNION ALL SELECT c_custkey, 'Modality', c_mktsegment FROM customer
UNION ALL SELECT c_custkey, 'PatientId', c_name FROM customer UNION ALL SELECT c_custkey, 'Sex', 'F' FROM customer WHERE c_custkey % 2 = 0""")


def _listing(spark, d):
    lines = T.table(spark, d, "part").select(F.when(F.col("p_partkey") % 4 == 0, F.lit("   ")).otherwise(
        F.concat(F.lit("  "), "p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" "))).alias("value"))
    path = scratch_path(spark, "listing")
    lines.write.mode("overwrite").text(path)
    return readers.listing(spark, path)


register("src_listing", _listing, "SELECT p_name || ' ' || p_partkey AS name FROM part WHERE p_partkey % 4 <> 0")
register("src_voxels", lambda spark, d: rounded(T.voxels3d(spark, d)),
         f"WITH {T.SQL_VOX} SELECT case_id, z, y, x, {r6('v')} AS v, m FROM vox")


def _units(spark, d):
    s = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    names = F.array(F.lit("images.lst"), F.when(F.col("k") % 4 != 0, "regionfile"), F.when(F.col("k") % 3 != 0, "label.json"))
    p = s.withColumn("name", F.explode(F.array_compact(names))).select(
        F.concat(F.lit("/units/u"), F.col("k").cast("string"), F.lit("/"), "name").alias("path"))
    return readers.complete_units(p)


register("src_complete_units", _units, "SELECT 'u' || s_suppkey AS unit FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 3 <> 0")


def _resume(spark, d):
    todo = T.targets(spark, d)
    path = scratch_path(spark, "done")
    todo.where("case_id % 4 = 0").select("case_id").write.mode("overwrite").parquet(path)
    return readers.pending(todo, spark.read.parquet(path), "case_id")


register("src_resume_anti", _resume, "SELECT vec_id AS case_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE vec_id % 4 <> 0")


def _validate(spark, d):
    cases = T.table(spark, d, "orders").select(F.col("o_custkey").alias("image"), (F.col("o_custkey") + 700).alias("mask"))
    known = T.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    a, b = known.withColumnRenamed("k", "ik"), known.withColumnRenamed("k", "mk")
    j = cases.join(a, F.col("image") == F.col("ik"), "left").join(b, F.col("mask") == F.col("mk"), "left")
    return j.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("ik").isNull()).alias("no_image"),
                 F.count_if(F.col("mk").isNull()).alias("no_mask"))


register("src_validate_paths", _validate,
         """SELECT count(*) AS cases, count(CASE WHEN a.c_custkey IS NULL THEN 1 END) AS no_image, count(CASE WHEN b.c_custkey IS NULL THEN 1 END) AS no_mask
FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey LEFT JOIN customer b ON b.c_custkey = o_custkey + 700""")

# ---- sinks ------------------------------------------------------------------------------------------------

register("sink_csv_roundtrip",
         lambda spark, d: sinks.roundtrip(spark, T.table(spark, d, "supplier"), scratch_path(spark, "csv"),
                                          "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE"),
         "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")


def _json_lines(spark, d):
    path = scratch_path(spark, "jsonl")
    sinks.json_lines(T.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")).write.mode("overwrite").text(path)
    return spark.read.text(path)


register("sink_json_lines", _json_lines,
         "SELECT CAST(json_object('c_custkey', c_custkey, 'c_name', c_name, 'c_mktsegment', c_mktsegment) AS VARCHAR) AS value FROM customer")


def _text_lines(spark, d):
    p = T.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"), F.col("p_brand").alias("brand"))
    path = scratch_path(spark, "text")
    sinks.text_lines(p.unpivot("p_partkey", ["size", "brand"], "name", "value"), "p_partkey").write.mode("overwrite").text(path)
    return spark.read.text(path)


register("sink_text_lines", _text_lines,
         """SELECT 'Case-' || p_partkey || '_size: ' || p_size AS value FROM part UNION ALL SELECT 'Case-' || p_partkey || '_brand: ' || p_brand FROM part""")


def _schema_union(spark, d):
    c = T.table(spark, d, "customer")
    a = c.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_name").alias("name"))
    b = c.where("c_custkey % 2 = 1").select("c_custkey", F.col("c_nationkey").alias("zone"), F.col("c_mktsegment").alias("area"))
    return sinks.union_headers([a, b])


register("sink_schema_union", _schema_union,
         """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS area,
CASE WHEN c_custkey % 2 = 1 THEN c_nationkey END AS zone FROM customer""")
register("sink_skip_nan",
         lambda spark, d: sinks.skip_nan(T.table(spark, d, "events").select(
             "event_id", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))),
         "SELECT event_id, value FROM events WHERE event_id % 3 <> 0 AND value IS NOT NULL")


def _paths(spark, d):
    p = F.regexp_replace("url", "^https?:/", "")
    t = T.table(spark, d, "pages").select("page_id", F.regexp_replace(p, "[?].*$", "").alias("p"))
    return t.select("page_id", sinks.path_format(F.col("p"), "basename").alias("basename"),
                    sinks.path_format(F.substring("p", 2, 10000), "absolute", "/web").alias("absolute"),
                    sinks.path_format(F.concat(F.lit("/web"), "p"), "relative", "/web").alias("relative"))


register("sink_path_format", _paths,
         r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?:/', ''), '[?].*$', '') AS p FROM pages)
SELECT page_id, regexp_extract(p, '([^/]*)$', 1) AS basename, CASE WHEN substr(p, 2) LIKE '/%' THEN substr(p, 2) ELSE '/web/' || substr(p, 2) END AS absolute, substr(p, 2) AS relative FROM t""")


def _matrix(spark, d):
    path = scratch_path(spark, "matrix")
    sinks.write_matrix(T.features(spark, d).select("f00", "f01", "f02"), path)
    return rounded(spark.read.schema("c0 DOUBLE, c1 DOUBLE, c2 DOUBLE").csv(path, header=False))


register("sink_matrix", _matrix,
         f"SELECT {', '.join(f'{r6(f'embedding[{k + 1}]::DOUBLE')} AS c{k}' for k in range(3))} FROM embeddings")


def _point_paths(spark, d):
    p = T.table(spark, d, "events").groupBy("user_id", F.hour("ts").alias("x")).agg(F.count(F.lit(1)).cast("int").alias("y"))
    return sinks.point_paths(p, "user_id", "x", "y")


register("sink_point_paths", _point_paths,
         """WITH p AS (SELECT user_id, hour(ts) AS x, count(*) AS y FROM events GROUP BY ALL)
SELECT user_id, '[' || string_agg('[' || x || ',' || y || ']', ',' ORDER BY x, y) || ']' AS path FROM p GROUP BY user_id""")
