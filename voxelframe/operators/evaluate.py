"""Evaluation of predictions: curves, reports, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.operators import ordering

GRID = 99  # the mean curve is read at g / 99, g = 0..99


def roc_points(scores: DataFrame, keys) -> DataFrame:
    """(keys, threshold, tp, fp, p, n) by descending score; ``hit`` is 1 for the positive class."""
    keys = list(keys)
    s = scores.select(*keys, F.col("score").cast("double").alias("threshold"), F.col("hit").cast("long").alias("pos"),
                      (1 - F.col("hit")).cast("long").alias("neg"))
    r = ordering.running(s, keys, "threshold", ["pos", "neg"], descending=True)
    return r.select(*keys, "threshold", "pos", "neg", F.col("run_pos").alias("tp"), F.col("run_neg").alias("fp"),
                    F.col("tot_pos").alias("p"), F.col("tot_neg").alias("n"))


def roc_curve(scores: DataFrame, keys) -> DataFrame:
    """(keys, threshold, fpr, tpr) starting at (0, 0) with threshold 1; an empty class gives 0."""
    keys = list(keys)
    pts = roc_points(scores, keys)
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    c = pts.select(*keys, "threshold", rate("fp", "n").alias("fpr"), rate("tp", "p").alias("tpr"))
    zero = pts.select(*keys).distinct().select(*keys, F.lit(1.0).alias("threshold"), F.lit(0.0).alias("fpr"),
                                               F.lit(0.0).alias("tpr"))
    return zero.unionByName(c)


def auc(scores: DataFrame, keys) -> DataFrame:
    """Trapezoid area: a tied score adds its negatives times the mean of the positives before and after."""
    keys = list(keys)
    pts = roc_points(scores, keys)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return pts.groupBy(*keys).agg(
        F.coalesce(F.try_divide(area, (F.max("p") * F.max("n")).cast("double")), F.lit(0.0)).alias("auc"))


def mean_roc(scores: DataFrame, fold: str, keys=()) -> DataFrame:
    """(keys, g, fpr, tpr, sd, lower, upper): folds' curves read at 100 places and averaged.

    Points go to the first grid place not left of them; the bracket of a place is then a running
    maximum and a running minimum over at most 100 rows per curve.
    """
    keys = list(keys)
    per = [*keys, fold]
    c = roc_curve(scores, per)
    b = F.ceil(F.col("fpr") * GRID)
    b = F.when((b - 1) / float(GRID) >= F.col("fpr"), b - 1).when(b / float(GRID) < F.col("fpr"), b + 1).otherwise(b)
    pt = F.struct("fpr", "tpr")
    cells = c.groupBy(*per, b.cast("int").alias("g")).agg(F.max(pt).alias("hi"), F.min(pt).alias("lo"))
    grid = c.select(*per).distinct().select(*per, F.explode(F.sequence(F.lit(0), F.lit(GRID))).alias("g"))
    w = Window.partitionBy(*per).orderBy("g")
    br = grid.join(cells, [*per, "g"], "left").select(
        *per, "g", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("a"),
        F.min("lo").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("b"))
    x = F.col("g") / float(GRID)
    dx = F.col("b.fpr") - F.col("a.fpr")
    t = F.when(F.col("b").isNull(), F.col("a.tpr")).otherwise(
        F.col("a.tpr") + (F.col("b.tpr") - F.col("a.tpr")) * (x - F.col("a.fpr")) / dx)
    br = br.withColumn("t", F.when(F.col("g") == 0, 0.0).otherwise(t))
    m = br.groupBy(*keys, "g").agg(F.avg("t").alias("tpr"), F.stddev_pop("t").alias("sd"))
    m = m.withColumn("tpr", F.when(F.col("g") == GRID, 1.0).otherwise(F.col("tpr")))
    return m.select(*keys, "g", (F.col("g") / float(GRID)).alias("fpr"), "tpr", "sd",
                    F.greatest(F.col("tpr") - F.col("sd"), F.lit(0.0)).alias("lower"),
                    F.least(F.col("tpr") + F.col("sd"), F.lit(1.0)).alias("upper"))


def confusion(pred: DataFrame, keys=()) -> DataFrame:
    return pred.groupBy(*keys, "label", "predict").agg(F.count(F.lit(1)).alias("n"))


def class_report(pred: DataFrame, keys=()) -> DataFrame:
    """Precision, recall, F1 and support per class, and their support-weighted mean (class 'avg').

    Works on the confusion counts, at most classes^2 rows per key.
    """
    keys = list(keys)
    c = confusion(pred, keys)
    side = F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"),
                 F.when(F.col("label") == F.col("predict"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predict").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"),
                 F.lit(0).cast("long").alias("hit"))))
    t = c.select(*keys, side.alias("t")).select(*keys, "t.*").groupBy(*keys, "class").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    p = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("called").cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    t = t.select(*keys, F.col("class").cast("string").alias("class"), "support", p.alias("precision"), r.alias("recall"))
    t = t.withColumn("f1", F.coalesce(F.try_divide(
        2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    wavg = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    avg = t.groupBy(*keys).agg(wavg("precision"), wavg("recall"), wavg("f1"), F.sum("support").alias("support"))
    cols = [*keys, "class", "precision", "recall", "f1", "support"]
    return t.select(*cols).unionByName(avg.withColumn("class", F.lit("avg")).select(*cols))


def sensitivity_specificity(pred: DataFrame, keys=()) -> DataFrame:
    """One-vs-rest recall and specificity per class, from the confusion counts."""
    keys = list(keys)
    c = confusion(pred, keys)
    tot = c.groupBy(*keys).agg(F.sum("n").alias("all"))
    side = F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"),
                 F.when(F.col("label") == F.col("predict"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predict").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"),
                 F.lit(0).cast("long").alias("hit"))))
    t = c.select(*keys, side.alias("t")).select(*keys, "t.*").groupBy(*keys, "class").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    if keys:
        t = t.join(tot, keys)
    else:  # tot is one row
        t = t.withColumn("_one", F.lit(1)).join(F.broadcast(tot.withColumn("_one", F.lit(1))), "_one")
    rest = F.col("all") - F.col("support")
    clean = rest - (F.col("called") - F.col("hit"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return t.select(*keys, F.col("class").cast("string").alias("class"),
                    ratio(F.col("hit"), F.col("support")).alias("sensitivity"), ratio(clean, rest).alias("specificity"))


def accuracy(pred: DataFrame, keys=()) -> DataFrame:
    return pred.groupBy(*keys).agg(F.avg((F.col("label") == F.col("predict")).cast("double")).alias("accuracy"))
