"""Descriptive analysis: principal components, clustering, cluster statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.operators import select


def zscore_wide(df: DataFrame, features) -> DataFrame:
    """z-scores of wide columns; the statistics are one row of 2p numbers kept as literals."""
    features = list(features)
    s = df.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    rest = [c for c in df.columns if c not in features]
    return df.select(*rest, *[((F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"] or 1.0)).alias(c) for c in features])


def pca(df: DataFrame, features, k: int = 10):
    """The fitted model on z-scores with min(p, k) components."""
    from pyspark.ml.feature import PCA

    data = select.assemble(zscore_wide(df, features), features)
    return PCA(k=min(len(list(features)), k), inputCol="features", outputCol="pcs").fit(data)


def pca_ratio(df: DataFrame, features, k: int = 10) -> DataFrame:
    """(pca, percent): share of variance per component, pc1 first."""
    m = pca(df, features, k)
    rows = [(f"pc{i + 1}", i + 1, round(float(v), 3) * 100) for i, v in enumerate(m.explainedVariance.toArray())]
    return df.sparkSession.createDataFrame(rows, "pca string, component int, percent double")


def pca_loadings(df: DataFrame, features, k: int = 10) -> DataFrame:
    m = pca(df, features, k).pc.toArray()
    rows = [(f, i + 1, float(m[j, i])) for j, f in enumerate(features) for i in range(m.shape[1])]
    return df.sparkSession.createDataFrame(rows, "feature string, component int, loading double")


def cumulative(ratio: DataFrame) -> DataFrame:
    """Running share over the components (at most k rows)."""
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return ratio.withColumn("cumulative", F.sum("percent").over(w))


def kmeans(df: DataFrame, features, k: int = 4, seed: int = 42):
    """(model, rows with class): fitted on z-scores."""
    from pyspark.ml.clustering import KMeans

    data = select.assemble(zscore_wide(df, features), features)
    m = KMeans(k=k, seed=seed).fit(data)
    out = m.transform(data).withColumn("class", F.concat(F.lit("cluster"), (F.col("prediction") + 1).cast("string")))
    return m, out.drop("prediction")


def distances(x, centres):
    """Array of Euclidean distances of array column x to each centre (k x p literals)."""
    return F.array(*[
        F.sqrt(F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)),
                           F.lit(0.0), lambda acc, v: acc + v)) for c in centres])


def assign(df: DataFrame, x: str, centres) -> DataFrame:
    """Nearest centre (first on ties) with its distance."""
    d = df.withColumn("_d", distances(F.col(x), centres))
    return d.withColumn("cluster", (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).withColumn(
        "distance", F.array_min("_d")).drop("_d")


def lloyd(df: DataFrame, x: str, centres, rounds: int):
    """Fixed starting centres, fixed number of rounds; k x p means come back after each round."""
    centres = [list(c) for c in centres]
    for _ in range(rounds):
        m = assign(df, x, centres).select("cluster", F.posexplode(x).alias("pos", "v")).groupBy("cluster", "pos").agg(
            F.avg("v").alias("v")).collect()
        for r in m:
            centres[r["cluster"]][r["pos"]] = r["v"]
    return centres


def cluster_statistics(assigned: DataFrame) -> DataFrame:
    """(class, number, percent, avg_distance)."""
    g = assigned.groupBy("class").agg(F.count(F.lit(1)).alias("number"), F.avg("distance").alias("avg_distance"))
    w = Window.partitionBy()  # one row per cluster
    return g.withColumn("percent", F.col("number") / F.sum("number").over(w))
