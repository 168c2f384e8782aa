"""Gradient-boosted trees for any number of classes, by histograms.

Features are cut into bins at their quantiles; a row is its bins (a byte each), its class and its raw score per class. In a
round every class gets a tree. A level of all these trees is one pass over the rows: each task sums first and second
derivatives of the softmax loss per (class, node, feature, bin), Spark adds the tasks' sums and takes the best split of each
node. Only split nodes come to the driver; trees are small tables. Scores are brought up to date in the tasks from the trees
since the last checkpoint, which is taken every few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelframe.operators import grid
from voxelframe.session import cut_lineage, settings

SUMS = "class int, node int, feature int, bin int, g double, h double"
CUT = 10  # rounds between checkpoints of the scores


@dataclass(frozen=True)
class Settings:
    rounds: int = 200
    depth: int = 10
    rate: float = 0.3
    l2: float = 1.0
    min_weight: float = 1.0   # second derivatives on either side of a split
    bins: int = 32            # 256 at most


@dataclass
class Tree:
    """Nodes as columns; node 0 is the root, a leaf has feature -1. A row goes left where its bin is at most `cut`."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: int = 0

    def split(self, node: int, feature: int, cut: int, gain: float, low: float, high: float) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.gain[node], self.left[node], self.right[node] = feature, cut, gain, at, at + 1
        for v in (low, high):
            for column, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.gain, 0.0), (self.value, v)):
                column.append(x)
        return at, at + 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row (of bins) ends in."""
        f, cut, left, right = (np.asarray(c) for c in (self.feature, self.cut, self.left, self.right))
        at, rows = np.zeros(len(bins), int), np.arange(len(bins))
        for _ in range(self.depth):
            go = np.where(bins[rows, np.maximum(f[at], 0)] <= cut[at], left[at], right[at])
            at = np.where(f[at] >= 0, go, at)
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.nodes(bins)]


@dataclass
class Model:
    features: list[str]
    classes: int
    edges: list[np.ndarray]            # upper ends of the bins of each feature but the last
    trees: list[list[Tree]]            # of each round, one a class

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Rows of values as bins. Missing values (NaN) lie above all others."""
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return added(np.zeros((len(x), self.classes)), self.bins(x), self.trees)

    def table(self, spark: SparkSession) -> DataFrame:
        """(round, class, node, feature, threshold, left, right, gain, value): a row for each node."""
        rows = [(r, k, n, self.features[t.feature[n]] if t.feature[n] >= 0 else None,
                 float(self.edges[t.feature[n]][t.cut[n]]) if t.feature[n] >= 0 else None, t.left[n], t.right[n], t.gain[n], t.value[n])
                for r, trees in enumerate(self.trees) for k, t in enumerate(trees) for n in range(len(t.feature))]
        return spark.createDataFrame(rows, "round int, class int, node int, feature string, threshold double, left int, right int, gain double, value double")


def importance(table: DataFrame, features) -> DataFrame:
    """(feature, importance) from a model's table: the mean gain of its splits, as a share of all features' means."""
    spark = table.sparkSession
    every = spark.createDataFrame([(f,) for f in features], "feature string")
    mean = table.where("feature IS NOT NULL").groupBy("feature").agg(F.avg("gain").alias("gain"))
    all_ = mean.agg(F.sum("gain")).first()[0] or 1.0
    return every.join(mean, "feature", "left").select("feature", (F.coalesce("gain", F.lit(0.0)) / F.lit(all_)).alias("importance"))


def added(raw: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    raw = raw.copy()
    for trees in rounds:
        for k, t in enumerate(trees):
            raw[:, k] += t.scores(bins)
    return raw


def derivatives(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the softmax loss by each class's raw score."""
    e = np.exp(raw - raw.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    return p - (y[:, None] == np.arange(raw.shape[1])), np.maximum(2 * p * (1 - p), 1e-16)


def cut_points(df: DataFrame, features, bins: int) -> list[np.ndarray]:
    """Distinct approximate quantiles of each feature: features x bins numbers."""
    if not 2 <= bins <= 256:
        raise ValueError("bins are a byte: 2 to 256")
    qs = [k / bins for k in range(1, bins)]
    got = df.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), qs, 100_000).alias(f"q{k}")
                   for k, f in enumerate(features)]).first()
    return [np.unique(np.array(got[k] or [], float)) for k in range(len(features))]


def _rows(batch: pa.RecordBatch, p: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, p)
    raw = batch.column("raw").flatten().to_numpy(zero_copy_only=False).reshape(-1, classes)
    return bins, raw, batch.column("y").to_numpy(zero_copy_only=False)


def _binned(df: DataFrame, model: Model, label: str) -> DataFrame:
    """(y, bins, raw): one row for each training row, dealt over all tasks."""
    @F.pandas_udf("binary")
    def as_bytes(x: pd.Series) -> pd.Series:
        return pd.Series([r.tobytes() for r in model.bins(np.vstack(x.to_numpy()).astype(float))])

    x = F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float("nan"))) for f in model.features])
    out = df.select(F.col(label).cast("int").alias("y"), as_bytes(x).alias("bins"), F.array(*[F.lit(0.0)] * model.classes).alias("raw"))
    return cut_lineage(out.repartition(grid.parallelism(df)))


def level_sums(state: DataFrame, model: Model, pending: list[list[Tree]], trees: list[Tree], active: list[list[int]]) -> DataFrame:
    """(class, node, feature, bin, g, h) of the active nodes of each class's tree, one set of rows a task."""
    p, classes = len(model.features), model.classes
    width = max(len(e) for e in model.edges) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, len(a) * p * width)) for a in active]
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, raw, y = _rows(batch, p, classes)
            g, h = derivatives(added(raw, bins, pending), y)
            place = np.arange(p) * width + bins
            for k, nodes in enumerate(active):
                if not nodes:
                    continue
                where = np.full(len(trees[k].feature), -1)
                where[nodes] = np.arange(len(nodes))
                at = where[trees[k].nodes(bins)]
                on = at >= 0
                cells = (at[on, None] * (p * width) + place[on]).ravel()
                for s, d in enumerate((g, h)):
                    sums[k][s] += np.bincount(cells, np.repeat(d[on, k], p), sums[k].shape[1])
        for k, nodes in enumerate(active):
            used = np.flatnonzero(sums[k][1])
            if len(used):
                node, rest = np.divmod(used, p * width)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(used), k, np.int32)), pa.array(np.asarray(nodes, np.int32)[node]), pa.array((rest // width).astype(np.int32)),
                    pa.array((rest % width).astype(np.int32)), pa.array(sums[k][0][used]), pa.array(sums[k][1][used])],
                    names=[c.split()[0] for c in SUMS.split(", ")])

    return state.mapInArrow(run, SUMS)


def best_splits(sums: DataFrame, s: Settings) -> DataFrame:
    """(class, node, g, h, best): the totals of each node and its best split (gain, feature, bin, g and h to the left), if any.

    The gain is that of the second-order loss; ties go to the first feature and bin. A node has features x bins rows here.
    """
    one = sums.repartition("class", "node", "feature").groupBy("class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    by = Window.partitionBy("class", "node", "feature")
    upto = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    one = one.select("class", "node", "feature", "bin", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"),
                     F.sum("g").over(by).alias("g"), F.sum("h").over(by).alias("h"), F.max("bin").over(by).alias("last"))
    part = lambda g, h: g * g / (h + s.l2)
    gl, hl, gr, hr = F.col("gl"), F.col("hl"), F.col("g") - F.col("gl"), F.col("h") - F.col("hl")
    gain = F.round((part(gl, hl) + part(gr, hr) - part(F.col("g"), F.col("h"))) / 2, 9)
    ok = (F.col("bin") < F.col("last")) & (hl >= s.min_weight) & (hr >= s.min_weight) & (gain > 1e-6)
    split = F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), gl.alias("gl"), hl.alias("hl"))
    return one.groupBy("class", "node").agg(F.first("g").alias("g"), F.first("h").alias("h"), F.max(F.when(ok, split)).alias("best"))


def grow(state: DataFrame, model: Model, pending: list[list[Tree]], s: Settings) -> list[Tree]:
    """One round: a tree for each class, level by level."""
    trees = [Tree() for _ in range(model.classes)]
    active: list[list[int]] = [[0] for _ in trees]
    value = lambda g, h: -s.rate * g / (h + s.l2)
    for level in range(s.depth):
        found = best_splits(level_sums(state, model, pending, trees, active), s).collect()  # a row a node
        active = [[] for _ in trees]
        for r in sorted(found, key=lambda r: (r["class"], r["node"])):
            t, b = trees[r["class"]], r["best"]
            t.value[r["node"]] = value(r["g"], r["h"])
            if b is not None:
                active[r["class"]] += t.split(r["node"], -b["f"], -b["b"], b["gain"], value(b["gl"], b["hl"]), value(r["g"] - b["gl"], r["h"] - b["hl"]))
                t.depth = level + 1
        if not any(active):
            break
    return trees


def fit(train: DataFrame, features, label: str, classes: int, s: Settings = Settings()) -> Model:
    """`label` holds 0 .. classes - 1. Ends early once no tree of a round finds a split that gains."""
    features = list(features)
    model = Model(features, classes, cut_points(train, features, s.bins), [])
    state = _binned(train, model, label)
    pending: list[list[Tree]] = []
    for _ in range(s.rounds):
        # what a level shuffles is of the size of its nodes, not of the rows: planning it anew at run time only takes longer
        with settings(train.sparkSession, {"spark.sql.adaptive.enabled": "false"}):
            trees = grow(state, model, pending, s)
        if all(t.depth == 0 for t in trees):
            break
        model.trees.append(trees)
        pending.append(trees)
        if len(pending) == CUT:
            state, pending = cut_lineage(_caught_up(state, model, pending)), []
    return model


def _caught_up(state: DataFrame, model: Model, pending: list[list[Tree]]) -> DataFrame:
    p, classes = len(model.features), model.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins, raw, _ = _rows(batch, p, classes)
                new = added(raw, bins, pending)
                yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("bins"), pa.array(list(new), pa.list_(pa.float64()))], names=["y", "bins", "raw"])

    return state.mapInArrow(run, "y int, bins binary, raw array<double>")


def scored(model: Model, test: DataFrame, out: str = "scores") -> DataFrame:
    """Test rows with the probability of each class."""
    @F.pandas_udf("array<double>")
    def probabilities(x: pd.Series) -> pd.Series:
        raw = model.raw(np.vstack(x.to_numpy()).astype(float))
        e = np.exp(raw - raw.max(1, keepdims=True))
        return pd.Series(list(e / e.sum(1, keepdims=True)))

    return test.withColumn(out, probabilities(F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float("nan"))) for f in model.features])))
