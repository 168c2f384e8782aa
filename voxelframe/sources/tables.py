"""Logical tables over the parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 4          # the embeddings hold 4 x 4 x 4 volumes
WIDTH = SIDE ** 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unpack_volume(df: DataFrame, case: str, array: str, ny: int, nx: int) -> DataFrame:
    """Decoded array column to one row per cell (z, y, x in row-major order)."""
    return df.select(
        F.col(case).cast("long").alias("case_id"), F.posexplode(array).alias("pos", "e")
    ).select(
        "case_id",
        F.expr(f"cast(pos div {ny * nx} as int)").alias("z"),
        F.expr(f"cast((pos div {nx}) % {ny} as int)").alias("y"),
        F.expr(f"cast(pos % {nx} as int)").alias("x"),
        F.col("e").cast("double").alias("v"),
    )


def voxels3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return unpack_volume(emb, "vec_id", "embedding", SIDE, SIDE).withColumn("m", F.lit(1))


def voxels3d_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same grid, mask = positive cells (a region with holes)."""
    return voxels3d(spark, sf_dir).withColumn("m", F.when(F.col("v") > 0, 1).otherwise(0))


def voxels2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day x hour image per user; present cells are the region."""
    ev = table(spark, sf_dir, "events")
    return (
        ev.groupBy(
            F.col("user_id").cast("long").alias("case_id"),
            F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("int").alias("y"),
            F.hour("ts").cast("int").alias("x"),
        )
        .agg(F.round(F.sum("value"), 4).alias("v"))
        .select("case_id", F.lit(0).alias("z"), "y", "x", "v", F.lit(1).alias("m"))
    )


def groups1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("case_id"), F.col("l_extendedprice").alias("v"))


def feature_names(width: int = WIDTH) -> list[str]:
    return [f"f{k:02d}" for k in range(width)]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide feature table: one DOUBLE column per embedding position."""
    emb = table(spark, sf_dir, "embeddings")
    cols = [F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate(feature_names())]
    return emb.select(F.col("vec_id").cast("long").alias("case_id"), *cols)


def features_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").cast("long").alias("case_id"),
        F.col("label").cast("long").alias("label"),
        F.posexplode("embedding").alias("pos", "e"),
    ).select(
        "case_id", "label",
        F.format_string("f%02d", "pos").alias("feature"),
        F.col("e").cast("double").alias("value"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").cast("long").alias("case_id"), F.col("label").cast("long").alias("label"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").cast("long").alias("case_id"),
        F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0).cast("long").alias("dataset"),
    )


# SQL twins of the logical tables, used as WITH entries
SQL_VOX = """vox AS (
  SELECT CAST(vec_id AS BIGINT) AS case_id, CAST((p - 1) // 16 AS INT) AS z, CAST(((p - 1) // 4) % 4 AS INT) AS y,
         CAST((p - 1) % 4 AS INT) AS x, CAST(e AS DOUBLE) AS v, 1 AS m
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS p FROM embeddings))"""

SQL_VOX_ROI = SQL_VOX.replace("1 AS m", "CASE WHEN e > 0 THEN 1 ELSE 0 END AS m")

SQL_VOX2D = """vox AS (
  SELECT CAST(user_id AS BIGINT) AS case_id, 0 AS z,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS y,
         CAST(hour(ts) AS INT) AS x, round(sum(value), 4) AS v, 1 AS m
  FROM events GROUP BY ALL)"""

SQL_GROUPS = "vox AS (SELECT l_suppkey AS case_id, l_extendedprice AS v, 1 AS m FROM lineitem)"

SQL_LONG = """fl AS (
  SELECT CAST(vec_id AS BIGINT) AS case_id, CAST(label AS BIGINT) AS label,
         printf('f%02d', p - 1) AS feature, CAST(e AS DOUBLE) AS value
  FROM (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS p FROM embeddings))"""
