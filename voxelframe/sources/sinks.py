"""Writers: CSV, JSON lines, text lines, matrices, point paths, partitioned voxel maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def text_lines(long: DataFrame, key: str) -> DataFrame:
    """Case-N_name: value."""
    return long.select(F.format_string("Case-%s_%s: %s", F.col(key).cast("string"), "name", "value").alias("value"))


def skip_nan(long: DataFrame, value: str = "value") -> DataFrame:
    return long.where(F.col(value).isNotNull() & ~F.isnan(value))


def union_headers(parts) -> DataFrame:
    """Rows under the first table's headers, then the other headers in order."""
    out = parts[0]
    first = list(out.columns)
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*first, *sorted(c for c in out.columns if c not in first))


def path_format(path: Column, style: str, base: str = "") -> Column:
    if style == "basename":
        return F.substring_index(path, "/", -1)
    if style == "relative":
        return F.when(path.startswith(base + "/"), F.substring(path, len(base) + 2, 100000)).otherwise(path)
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base + "/"), path))


def write_matrix(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=False)


def point_paths(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """One [[x, y], ..] document per series (a drawn curve: at most a few hundred points)."""
    arr = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    return points.groupBy(key).agg(F.to_json(F.transform(arr, lambda p: F.array(p["x"], p["y"]))).alias("path"))


def write_voxel_maps(maps: DataFrame, path: str) -> None:
    maps.write.mode("overwrite").partitionBy("feature").parquet(path)


def roundtrip(spark: SparkSession, df: DataFrame, path: str, schema: str) -> DataFrame:
    write_csv(df, path)
    return spark.read.schema(schema).csv(path, header=True)
