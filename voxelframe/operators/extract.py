"""Extraction: voxel table in, long feature table out; cases are rows, never a driver loop."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.functions import names as names_module
from voxelframe.functions import registry
from voxelframe.operators import cooccurrence as co
from voxelframe.operators import components, emphasis, filters, grid, mesh, texture, weighted, windows
from voxelframe.session import stage

# fixed values: the full parameter grid
BIN_COUNTS = (2, 4, 8, 32, 64)
DISTANCES = (1, 2, 3)
SHAPE_BIN_COUNTS = (1, *BIN_COUNTS)
CLASSES = ("firstorder", "shape", "glcm", "glrlm")
ALL_CLASSES = (*CLASSES, "gldm", "ngtdm", "glszm")
# an image type is a function of the voxel table; one that gives several images names them in a column image_type
IMAGE_TYPES = {"original": lambda v: v, "square": filters.square, "squareroot": filters.square_root,
               "logarithm": filters.logarithm, "exponential": filters.exponential, "gradient": filters.gradient,
               **{f"log-sigma-{s}": (lambda v, s=s: filters.log_sigma(v, float(s))) for s in (1, 2, 3)},
               "wavelet": filters.wavelet}
MIN_CELLS = 10


def usable(vox: DataFrame, label: int = 1, min_cells: int = MIN_CELLS, min_dims: int = 2) -> DataFrame:
    """Region cells of cases whose region is large enough and spans enough axes."""
    cells = grid.roi(vox, label)
    box = cells.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), *[
        F.when(F.max(a) > F.min(a), 1).otherwise(0).alias(f"d{a}") for a in ("z", "y", "x")])
    ok = box.where((F.col("n") > min_cells) & (F.col("dz") + F.col("dy") + F.col("dx") >= min_dims)).select("case_id")
    return cells.join(ok, "case_id", "left_semi")


def with_label(vox: DataFrame, cases: DataFrame) -> DataFrame:
    """Cells of the label each case asks for (default 1)."""
    return vox.join(cases.select("case_id", "label"), "case_id").where(
        F.col("m") == F.coalesce("label", F.lit(1))).drop("label")


def _named(long: DataFrame, cls: str, bins: bool = False, dist: bool = False, variant: bool = False) -> DataFrame:
    name = names_module.parameterised(cls, F.col("feature"), F.col("bin_count") if bins else None,
                               F.col("dist") if dist else None, F.col("variant") if variant else None)
    return long.select("case_id", name.alias("feature"), F.col("value").cast("double").alias("value"))


FEW = 4  # statistics taken one by one; more share one block


def first_order(cells: DataFrame, wanted=None) -> DataFrame:
    vw = weighted.collapse(cells, ["case_id"])
    if wanted and len(wanted) <= FEW and not set(wanted) & {"TrimmedMean", "Deciles"}:
        vw = stage(vw, "values")
        return reduce(DataFrame.unionByName, [_named(weighted.statistic(vw, ["case_id"], n).withColumn("feature", F.lit(n)), "firstorder") for n in wanted])
    return _named(weighted.to_long(weighted.block(vw, ["case_id"]), ["case_id"]), "firstorder")


def glcm(cells: DataFrame, bin_counts=BIN_COUNTS, distances=DISTANCES, wanted=None, dense: bool = True) -> DataFrame:
    cases = texture.measure_cases(cells, distances)
    p = texture.normalise(texture.glcm_counts(cells, bin_counts, distances, totals=True, cases=cases))
    lev = texture.glcm_levels(cells, bin_counts, cases)
    names, dense = wanted or co.FORMULAS, dense and wanted is None
    if dense or not co.in_one_pass(names):
        p = stage(p, "glcm")  # many times the cells: only what is read again is written
    out = _named(co.features(p, lev, names), "glcm", True, True, True)
    if dense:
        vw = co.dense_values(p, lev)
        blk = weighted.block(vw, co.KEYS, with_variance=False).drop("RobustMeanAbsoluteDeviation", "L2Norm")
        out = out.unionByName(_named(weighted.to_long(blk, co.KEYS).withColumn("variant", F.lit("value")), "glcm", True, True, True))
    return out


def _wide_to_named(df: DataFrame, keys, cls: str) -> DataFrame:
    return _named(weighted.to_long(df, keys), cls, True)


def run_length(cells: DataFrame, bin_counts=BIN_COUNTS, wanted=None) -> DataFrame:
    keys = ["case_id", "bin_count"]
    c = texture.glrlm_counts(grid.discretise_many(cells, bin_counts), keys).withColumnRenamed("len", "j")
    return _wide_to_named(emphasis.cell_features(c, keys, emphasis.run_length(), wanted, angle=True), keys, "glrlm")


def dependence(cells: DataFrame, bin_counts=BIN_COUNTS, wanted=None) -> DataFrame:
    keys = ["case_id", "bin_count"]
    c = texture.gldm_counts(grid.discretise_many(cells, bin_counts), 0, keys).withColumnRenamed("dep", "j")
    return _wide_to_named(emphasis.cell_features(c, keys, emphasis.dependence(), wanted), keys, "gldm")


def neighbourhood(cells: DataFrame, bin_counts=BIN_COUNTS) -> DataFrame:
    keys = ["case_id", "bin_count"]
    t = texture.ngtdm_table(grid.discretise_many(cells, bin_counts), keys)
    return _wide_to_named(emphasis.ngtdm_features(t, keys), keys, "ngtdm")


def zones(cells: DataFrame, bin_counts=BIN_COUNTS, wanted=None) -> DataFrame:
    """Zones of one level, of all cases, image types and bin counts from one contraction."""
    keys = ["case_id", "bin_count"]
    c = components.zone_counts(stage(grid.discretise_many(cells, bin_counts).select(*keys, "z", "y", "x", "g"), "levels"), keys)
    return _wide_to_named(emphasis.cell_features(c.withColumnRenamed("size", "j"), keys, emphasis.zone(), wanted), keys, "glszm")


def shape(cells: DataFrame, bin_counts=SHAPE_BIN_COUNTS, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    s = mesh.shape_features(cells, bin_counts, spacing=spacing)
    long = weighted.to_long(s, ["case_id", "bin_count", "g"])
    name = F.concat_ws("_", F.lit("shape"), F.col("feature"), F.lit("b"), F.col("bin_count").cast("string"), F.lit("l"),
                       F.col("g").cast("string"))
    return long.select("case_id", name.alias("feature"), "value")


def segment(vox: DataFrame, classes=CLASSES, bin_counts=BIN_COUNTS, distances=DISTANCES, label: int = 1,
            min_cells: int = MIN_CELLS, spacing=(1.0, 1.0, 1.0), names=None) -> DataFrame:
    """(case_id, feature, value) of every usable case for the wanted classes, and of these for the wanted features."""
    cells = stage(usable(vox, label, min_cells), "cells")
    return features(cells, Settings(classes=tuple(classes), bin_counts=tuple(bin_counts), distances=tuple(distances), spacing=spacing, names=names or {}), classes)


def wide(long: DataFrame, cases: DataFrame, wanted) -> DataFrame:
    """One row per case with the named columns; a case that gave nothing keeps its key columns."""
    p = long.where(F.col("feature").isin(*wanted)).groupBy("case_id").pivot("feature", list(wanted)).agg(F.first("value"))
    return cases.join(p, "case_id", "left")


def image_types(vox: DataFrame, wanted=tuple(IMAGE_TYPES)) -> DataFrame:
    """Derived images side by side: the case key becomes (case_id, image_type)."""
    out = None
    for t in wanted:
        one = (IMAGE_TYPES.get(t) or registry.FILTERS[t])(vox)
        if "image_type" not in one.columns:
            one = one.withColumn("image_type", F.lit(t))
        one = one.withColumn("case_id", F.struct("case_id", "image_type")).drop("image_type")
        out = one if out is None else out.unionByName(one)
    return out


@dataclass(frozen=True)
class Settings:
    """What an extraction does, in the order it does it."""

    label: int = 1
    normalise: float | None = None                      # scale of the normalised image
    clip: float | None = None                           # in standard deviations
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)
    new_spacing: tuple[float, float, float] | None = None
    interpolator: str = "linear"                        # of the image: linear or spline
    min_cells: int = MIN_CELLS
    resegment: tuple[float, float | None, str] | None = None   # low, high, mode
    resegment_shape: bool = False                       # shape of the resegmented region
    image_types: tuple[str, ...] = ("original",)
    classes: tuple[str, ...] = CLASSES
    bin_counts: tuple[int, ...] = BIN_COUNTS
    distances: tuple[int, ...] = DISTANCES
    plugins: bool = True                                # registered features too
    names: dict[str, tuple[str, ...]] = field(default_factory=dict)   # class -> wanted features; all where missing


def features(cells: DataFrame, s: Settings, classes) -> DataFrame | None:
    build = {
        "firstorder": lambda: first_order(cells, s.names.get("firstorder")),
        "shape": lambda: shape(cells, (1, *s.bin_counts), s.new_spacing or s.spacing),
        "glcm": lambda: glcm(cells, s.bin_counts, s.distances, s.names.get("glcm")),
        "glrlm": lambda: run_length(cells, s.bin_counts, s.names.get("glrlm")),
        "gldm": lambda: dependence(cells, s.bin_counts, s.names.get("gldm")),
        "ngtdm": lambda: neighbourhood(cells, s.bin_counts),
        "glszm": lambda: zones(cells, s.bin_counts, s.names.get("glszm")),
    }
    parts = []
    for c in classes:
        one = build[c]()
        if c in s.names:
            wanted = [F.col("feature").rlike(f"^{c}_{n}(_|$)") for n in s.names[c]]
            one = one.where(reduce(lambda a, b: a | b, wanted, F.lit(False)))
        parts.append(stage(one, f"features-{c}"))  # a class is a job of its own
    return reduce(DataFrame.unionByName, parts) if parts else None


def provenance(image: DataFrame, region: DataFrame) -> DataFrame:
    """(case_id, image_type, feature, value): what the features were taken from."""
    whole = image.groupBy("case_id").agg(F.avg("v").alias("Image_Mean"), F.min("v").alias("Image_Minimum"), F.max("v").alias("Image_Maximum"))
    own = region.groupBy("case_id").agg(F.count(F.lit(1)).cast("double").alias("Mask_VoxelNum"), F.avg("v").alias("Mask_Mean"),
                                        F.min("v").alias("Mask_Minimum"), F.max("v").alias("Mask_Maximum"))
    both = own.join(whole, "case_id")
    return both.unpivot("case_id", [c for c in both.columns if c != "case_id"], "feature", "value").select(
        "case_id", F.lit("diagnostics").alias("image_type"), "feature", "value")


def provenance_of_steps(steps) -> DataFrame:
    """(case_id, image_type, feature, value): image and mask after each step, ``steps`` being (name, image or None, region, spacing).

    Of an image: number of axes (always three), spacing, size, mean, range and two halves (below 2**32) of a fingerprint that does not depend on the order of
    rows. Of a mask: spacing, box (first cell and size), cells, 26-connected parts, centre in cells and in space (origin 0), mean
    and range. The parts of all cases and steps come from one contraction. A case without image or region has no such rows.
    """
    key = ["case_id", "step"]
    both = {k: reduce(DataFrame.unionByName, [t[i].select("case_id", F.lit(t[0]).alias("step"), *filters.AXES, "v") for t in steps if t[i] is not None])
            for k, i in (("Image", 1), ("Mask", 2))}
    both["Mask"] = stage(both["Mask"], "provenance-mask")
    space = {a: F.coalesce(*[F.when(F.col("step") == t[0], F.lit(float(t[3][k]))) for t in steps]) for k, a in enumerate(filters.AXES)}
    size = {a: F.max(a) - F.min(a) + 1 for a in filters.AXES}
    summary = {"Mean": F.avg("v"), "Minimum": F.min("v"), "Maximum": F.max("v")}
    print_ = F.bit_xor(F.xxhash64(*filters.AXES, "v"))
    facts = {"Image": {"Dimensionality": F.max(F.lit(3)), **{f"Size_{a}": size[a] for a in filters.AXES},
                       "Hash_High": F.shiftrightunsigned(print_, 32), "Hash_Low": print_.bitwiseAND(F.lit(0xFFFFFFFF)), **summary},
             "Mask": {"VoxelNum": F.count(F.lit(1)), **{f"BoundingBox_{a}": F.min(a) for a in filters.AXES}, **{f"BoundingBox_n{a}": size[a] for a in filters.AXES},
                      **{f"CenterOfMassIndex_{a}": F.avg(a) for a in filters.AXES}, **summary}}
    out = []
    for kind, table in both.items():
        t = table.groupBy(*key).agg(*[c.cast("double").alias(n) for n, c in facts[kind].items()]).withColumns({f"Spacing_{a}": c for a, c in space.items()})
        if kind == "Mask":
            t = t.withColumns({f"CenterOfMass_{a}": F.col(f"CenterOfMassIndex_{a}") * F.col(f"Spacing_{a}") for a in filters.AXES})
            parts = components.components(table.select(*key, *filters.AXES), key).where(F.col("comp") == grid.cell_key())
            t = t.join(parts.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("VolumeNum")), key)
        long = t.unpivot(key, [c for c in t.columns if c not in key], "feature", "value")
        out.append(long.select("case_id", F.lit("diagnostics").alias("image_type"), F.concat(F.lit(f"{kind}-"), "step", F.lit("_"), "feature").alias("feature"), "value"))
    return out[0].unionByName(out[1])


def compose(vox: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(case_id, image_type, feature, value): the whole chain from voxels to features.

    Normalise the image, resample image (``s.interpolator``) and mask (nearest) to the new spacing, drop unusable regions, take
    shape, resegment, derive the image types from the whole image and take the other classes and the registered features of each.
    Provenance covers image and mask as read, resampled and resegmented, of the cases that are left.
    """
    read = vox
    if s.normalise is not None:
        vox = filters.normalise(vox, s.normalise, s.clip)
    if s.new_spacing is not None:
        if s.interpolator == "nearest":
            raise ValueError("the image is resampled linearly or by a spline")
        geo = grid.bounding_box(vox).select("case_id", *[(F.col(f"{a}1") - F.col(f"{a}0") + 1).alias(f"n{a}") for a in filters.AXES],
                                            *[F.lit(float(x)).alias(f"d{a}") for a, x in zip(filters.AXES, s.spacing)])
        mask = filters.resample(vox, geo, s.new_spacing, "nearest").drop("v")
        vox = filters.resample(vox, geo, s.new_spacing, s.interpolator).join(mask, ["case_id", *filters.AXES])
    vox = stage(vox, "image")
    region = stage(usable(vox, s.label, s.min_cells), "region")
    kept = region if s.resegment is None else stage(filters.resegment(region, *s.resegment, label=s.label), "resegmented")
    out = []
    if "shape" in s.classes:
        part = features(kept if s.resegment_shape else region, s, ["shape"])
        out.append(part.select("case_id", F.lit("original").alias("image_type"), "feature", "value"))
    place = kept.select("case_id", *filters.AXES)
    images = image_types(vox.join(place.select("case_id").distinct(), "case_id", "left_semi"), s.image_types)
    cells = images.join(place.select(F.col("case_id").alias("of"), *filters.AXES),
                        (F.col("case_id.case_id") == F.col("of")) & reduce(lambda a, b: a & b, [images[c] == place[c] for c in filters.AXES]), "left_semi")
    cells = stage(cells.withColumn("m", F.lit(1)), "images")
    rest = features(cells, s, [c for c in s.classes if c != "shape"])
    if rest is not None:
        out.append(rest.select("case_id.case_id", "case_id.image_type", "feature", "value"))
    own = registry.enabled("roi")
    if s.plugins and own:
        wide_ = registry.apply(cells, ["case_id"])
        long = wide_.select("case_id", *[F.col(f.name).cast("double").alias(f.name) for f in own]).unpivot(
            "case_id", [f.name for f in own], "feature", "value")
        out.append(long.select("case_id.case_id", "case_id.image_type", F.concat(F.lit("plugin_"), "feature").alias("feature"), "value"))
    cases = kept.select("case_id").distinct()
    own_image, read = (t.join(cases, "case_id", "left_semi") for t in (vox, read))
    steps = [("original", read, grid.roi(read, s.label), s.spacing)]
    if s.new_spacing is not None:
        new = [b or a for a, b in zip(s.spacing, s.new_spacing)]  # 0 keeps an axis
        steps.append(("interpolated", own_image, region.join(cases, "case_id", "left_semi"), new))
    if s.resegment is not None:
        steps.append(("resegmented", None, kept, steps[-1][3]))
    out += [provenance(own_image, kept), provenance_of_steps(steps)]
    return reduce(DataFrame.unionByName, out)


def kernels(cells: DataFrame, radius: int = 1, carry=("v",)) -> DataFrame:
    """Each region cell's neighbourhood as a case of its own: case_id becomes (case_id, z, y, x) of the centre."""
    span = range(-radius, radius + 1)
    offs = [(k, 0, *o) for k, o in enumerate(product(span, span, span))]
    p = grid.neighbour_pairs(cells.select("case_id", "z", "y", "x", *carry), offs, carry=carry)
    centre = F.struct("case_id", "z", "y", "x")
    return p.select(centre.alias("case_id"), F.col("z2").alias("z"), F.col("y2").alias("y"), F.col("x2").alias("x"),
                    *[F.col(f"{c}2").alias(c) for c in carry])


def _map_names(spark: SparkSession, names, distances) -> dict[tuple[str, int], list[str]]:
    """The features of a map by class and distance, a few hundred: also those that no cell of the data has a value of."""
    pairs = [(n, d, v) for n, v in co.variants(names.get("glcm", ())) for d in distances]
    named = spark.createDataFrame(pairs, "feature string, dist int, variant string").select(
        "dist", names_module.parameterised("glcm", F.col("feature"), None, F.col("dist"), F.col("variant")).alias("feature")).collect()
    return {("firstorder", 0): [f"firstorder_{n}" for n in names.get("firstorder", ())],
            **{("glcm", d): [r["feature"] for r in named if r["dist"] == d] for d in distances}}


def voxel_map(vox: DataFrame, bins: int = 8, radius: int = 1, init: float = 0.0, names=None, distances=(1,)) -> DataFrame:
    """(case_id, z, y, x, feature, value) for every grid cell: features of the cube around each region cell, levels taken from
    the whole region; other cells, and features without a value, hold the initial value.

    ``names`` are the wanted features of the classes firstorder and glcm (see windows.MOMENT_NAMES, windows.ORDER_NAMES and
    cooccurrence.FORMULAS); all of both where it is not given. A cell stays one row whatever the radius (see windows).
    """
    names = names or {"firstorder": (*windows.MOMENT_NAMES, *windows.ORDER_NAMES), "glcm": co.FORMULAS}
    cells = stage(grid.discretise(grid.roi(vox), bins).select("case_id", "z", "y", "x", "v", "g", F.lit(bins).alias("bin_count")), "region")
    place, parts, named = ["case_id", "z", "y", "x"], [], _map_names(vox.sparkSession, names, distances)
    empty = lambda at, wanted: at.select(*place, F.explode(F.array(*[F.lit(f) for f in wanted])).alias("feature"), F.lit(None).cast("double").alias("value"))
    own = names.get("firstorder", ())
    sums, ranks = ([n for n in own if n in some] for some in (windows.MOMENT_NAMES, windows.ORDER_NAMES))
    if len(sums) + len(ranks) < len(own):
        raise ValueError(f"unknown among {own}")
    for some, table in ((sums, lambda: windows.moments(cells, radius, sums)),
                        (ranks, lambda: windows.order_statistics(windows.gathered(cells, radius), ranks))):
        if some:
            long = weighted.to_long(table(), place).withColumn("feature", F.concat(F.lit("firstorder_"), "feature"))
            parts.append(stage(long, "map-firstorder"))
    if names.get("glcm"):
        counts = windows.pair_counts(cells, radius, distances).where("i IS NOT NULL AND j IS NOT NULL")
        p = stage(texture.normalise(counts), "map-pairs")
        long = co.features(p, stage(windows.level_facts(cells, radius), "map-levels"), names["glcm"])
        name = names_module.parameterised("glcm", F.col("feature"), None, F.col("dist"), F.col("variant"))
        parts.append(long.select("case_id.case_id", "case_id.z", "case_id.y", "case_id.x", name.alias("feature"), "value"))
        for d in distances:  # a cell with a pair has a row of each feature
            paired = p.where(F.col("dist") == d).select("case_id.*").distinct()
            parts.append(empty(cells.join(paired, place, "left_anti"), named["glcm", d]))
    parts.append(empty(vox.join(cells, place, "left_anti"), sum(named.values(), [])))
    return reduce(DataFrame.unionByName, parts).withColumn("value", F.coalesce("value", F.lit(float(init))))
