"""Column selection, joins and preparation of feature tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.session import stage

# fixed values: key columns of a feature table; every other column is a feature
KEYWORDS = ("mask", "image", "label", "dataset", "pid", "Mask", "Image", "Set1", "Set2", "Set3", "Set4", "Set5")
# fixed values: feature classes, of the external and of the built-in path
CLASSES = ("firstorder", "shape", "glcm", "glrlm", "glszm", "gldm", "ngtdm")
BUILT_IN = ("firstorder", "shape", "glcm", "glrlm")


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEYWORDS]


def choose_features(df: DataFrame, classes=CLASSES) -> DataFrame:
    return df.select(*[c for c in df.columns if c in ("image", "mask") or c.startswith(tuple(classes))])


def reorder(df: DataFrame, first) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def unpivot(df: DataFrame, keys, columns, name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def last_wins(left: DataFrame, right: DataFrame, key: str, position: str) -> DataFrame:
    """Left join on a key compared as text; of duplicate keys on the right the last one counts."""
    cols = [c for c in right.columns if c not in (key, position)]
    r = right.withColumn(key, F.col(key).cast("string")).groupBy(key).agg(
        *[F.max_by(F.struct(c), position)[c].alias(c) for c in cols])
    return left.withColumn(key, F.col(key).cast("string")).join(r, key, "left")


def natural(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, [c for c in left.columns if c in right.columns])


def prepare(features: DataFrame, targets: DataFrame, tags: DataFrame | None = None, key: str = "mask") -> DataFrame:
    """Features joined to non-null targets and tags; test rows of labels unseen in training dropped."""
    out = features.join(targets.na.drop().select(key, "label"), key)
    if tags is not None:
        out = natural(out, tags)
        out = out.join(out.where("dataset = 0").select("label").distinct(), "label", "left_semi")
    return out


# ---- long-form preparation: (key, feature, value) ---------------------------------------------------

def _fitted(long: DataFrame, stats: DataFrame) -> DataFrame:
    """Values with the statistics of their feature; a feature without any raises instead of vanishing."""
    known = stats.withColumn("_known", F.lit(True))  # one row per feature; broadcast by size when it is small
    unknown = F.raise_error(F.concat(F.lit("feature that was not fitted: "), F.coalesce("feature", F.lit("null"))))
    return long.join(known, "feature", "left").withColumn(
        "feature", F.when(F.col("_known"), F.col("feature")).otherwise(unknown.cast("string"))).drop("_known")


def check_fitted(long: DataFrame, stats: DataFrame) -> None:
    """Raise unless the values have exactly the fitted features (as many rows as there are features are compared)."""
    a, b = long.select("feature").distinct(), stats.select("feature").distinct()
    odd = a.join(b, "feature", "left_anti").withColumn("why", F.lit("not fitted")).unionByName(
        b.join(a, "feature", "left_anti").withColumn("why", F.lit("missing"))).orderBy("feature").limit(5).collect()
    if odd:
        raise ValueError("features differ from the fitted ones: " + ", ".join(f"{r['feature']} ({r['why']})" for r in odd))


def impute(long: DataFrame) -> DataFrame:
    """Missing numbers become the feature's mean, or 0 where the feature is all missing."""
    v = F.when(~F.isnan("value"), F.col("value"))
    stats = long.groupBy("feature").agg(F.avg(v).alias("mu"))
    return _fitted(long, stats).withColumn("value", F.coalesce(v, F.col("mu"), F.lit(0.0))).drop("mu")


def fit_zscore(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))


def apply_zscore(long: DataFrame, stats: DataFrame) -> DataFrame:
    """Values scaled by saved statistics; unknown features raise, see check_fitted for missing ones."""
    sd = F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    return _fitted(long, stats).withColumn("value", (F.col("value") - F.col("mu")) / sd).drop("mu", "sd")


def zscore(long: DataFrame) -> DataFrame:
    return apply_zscore(long, fit_zscore(long))


def minmax(long: DataFrame, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    stats = long.groupBy("feature").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    x = F.coalesce(F.try_divide(F.col("value") - F.col("a"), F.col("b") - F.col("a")), F.lit(0.0))
    return _fitted(long, stats).withColumn("value", x * (hi - lo) + lo).drop("a", "b")


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): distinct values numbered from 0 in ascending order.

    Values are dealt by ranges and numbered within; a range adds the counts of those before it, so any number of distinct
    values is handled.
    """
    d = df.select(F.coalesce(F.col(col), F.lit("NA")).alias("value")).distinct().repartitionByRange("value")
    d = stage(d.withColumn("part", F.spark_partition_id()), "codes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    starts = d.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    return d.withColumn("inside", inside).join(F.broadcast(starts), "part").select(
        (F.col("start") + F.col("inside")).cast("int").alias("code"), "value")


def label_encode(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    codes = label_codes(df, col).withColumnRenamed("code", out)
    return df.join(codes, F.coalesce(F.col(col), F.lit("NA")) == codes["value"]).drop("value")


def classes(df: DataFrame, col: str, most: int = 10_000) -> list:
    """The distinct values of a class column in ascending order; more than `most` raise."""
    found = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} classes")
    return sorted(found)


def binarize(df: DataFrame, col: str, keys, prefix: str = "c") -> DataFrame:
    """One 0/1 column for each class that the data has."""
    return df.select(*keys, *[F.when(F.col(col) == c, 1).otherwise(0).alias(f"{prefix}{c}") for c in classes(df, col)])


def all_true(df: DataFrame, flags) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, [F.col(c) == 1 for c in flags]), F.lit(False))


def correlations(wide: DataFrame, names) -> DataFrame:
    """(a, b, r): Pearson correlation of every pair of columns, in one pass over the rows.

    The partial Gram matrices are combined in a tree; only the p x p result reaches the driver.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    names = list(names)
    vec = VectorAssembler(inputCols=names, outputCol="v").transform(wide.select(*names)).select("v")
    m = Correlation.corr(vec, "v").first()[0].toArray()
    spark = wide.sparkSession
    rows = spark.createDataFrame([(n, m[i].tolist()) for i, n in enumerate(names)], "a string, rs array<double>")
    by = F.array(*[F.lit(n) for n in names])
    return rows.select("a", F.posexplode("rs").alias("k", "r")).select("a", F.get(by, F.col("k")).alias("b"), "r")
