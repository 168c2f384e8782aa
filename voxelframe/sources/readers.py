"""Readers of case lists, feature tables, listings and nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

# fixed values: metadata keys that are kept
METADATA_KEYS = ("age", "modality", "patientId", "seriesId", "sex", "studyId")

CLINICAL = "columns ARRAY<STRUCT<name: STRING, `group`: STRING, type: STRING, intent: STRING>>, data ARRAY<ARRAY<STRING>>"
LABEL_DEFS = "ARRAY<STRUCT<labelSetId: STRING, name: STRING, labels: ARRAY<STRUCT<labelId: STRING, name: STRING>>>>"
REGIONS = "ARRAY<STRUCT<regionId: STRING, data: ARRAY<STRUCT<index: INT, path: ARRAY<ARRAY<DOUBLE>>>>>>"


def by_name(spark: SparkSession, path: str, required, optional=(), **options) -> DataFrame:
    """A CSV file with a header as text columns: the required ones first, then the optional ones (null where the file has
    none), then all others as they stand. Columns are found by name; a required one that is missing raises."""
    df = spark.read.csv(path, header=True, **options)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(df.columns)}")
    rest = [c for c in df.columns if c not in (*required, *optional)]
    have = [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in (*required, *optional)]
    return df.select(*have, *[F.col(f"`{c}`") for c in rest])


def cases(spark: SparkSession, path: str) -> DataFrame:
    """image, mask and whatever else the list has."""
    return by_name(spark, path, ("image", "mask"))


def _resolve(path: Column, base: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.lit(base), path))


def batch_cases(spark: SparkSession, path: str, base: str | None = None, legacy: bool = False,
                default_label: int = 1) -> DataFrame:
    """Rows with both paths; relative paths belong to the list's folder. Other columns pass through.

    The legacy list treats an empty string as missing and takes only all-digit labels.
    """
    base = base or path.rstrip("/").rsplit("/", 1)[0]
    df = by_name(spark, path, ("Image", "Mask"), ("Label", "Label_channel"), emptyValue="")
    have = F.col("Image").isNotNull() & F.col("Mask").isNotNull()
    have = have & (F.trim("Image") != "") & (F.trim("Mask") != "")
    if legacy:
        label = F.when(F.col("Label").rlike("^[0-9]+$"), F.col("Label").cast("int")).otherwise(default_label)
    else:
        label = F.expr("try_cast(Label AS INT)")
    return df.where(have).select(
        _resolve(F.col("Image"), base).alias("Image"), _resolve(F.col("Mask"), base).alias("Mask"),
        label.alias("Label"), F.expr("try_cast(Label_channel AS INT)").alias("Label_channel"),
        *[F.col(f"`{c}`") for c in df.columns[4:]])


def feature_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of the schema, found by name and cast; a value that does not fit its type raises. Other columns of the
    file follow as text."""
    types = {f.name: f.dataType for f in _parse_datatype_string(schema).fields}
    df = by_name(spark, path, tuple(types))
    return df.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def json_table(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(doc, row, name, value): cells of {columns, data} documents.

    A file is one document however it is laid out, or with ``lines`` one document a line. Anything else raises.
    """
    df = spark.read.schema(CLINICAL).json(path, multiLine=not lines, mode="FAILFAST").withColumn("doc", F.xxhash64(F.to_json("data")))
    rows = df.select("doc", "columns", F.posexplode("data").alias("row", "cells"))
    cells = rows.select("doc", "row", "columns", F.posexplode("cells").alias("k", "value"))
    col = F.get("columns", F.col("k"))
    return cells.select("doc", "row", col["name"].alias("name"), col["group"].alias("grp"), col["type"].alias("type"),
                        col["intent"].alias("intent"), "value")


def label_definitions(df: DataFrame, col: str = "doc") -> DataFrame:
    """(labelSetId, set_name, labelId, label_name) from label-definition documents."""
    s = df.select(F.explode(F.from_json(col, LABEL_DEFS)).alias("s"))
    return s.select("s.labelSetId", F.col("s.name").alias("set_name"), F.explode("s.labels").alias("l")).select(
        "labelSetId", "set_name", "l.labelId", F.col("l.name").alias("label_name"))


def regions(df: DataFrame, col: str = "doc") -> DataFrame:
    """(regionId, contour, index, ord, px, py) from region documents."""
    r = df.select(F.explode(F.from_json(col, REGIONS)).alias("r"))
    c = r.select("r.regionId", F.posexplode("r.data").alias("contour", "d"))
    p = c.select("regionId", "contour", F.col("d.index").alias("index"), F.posexplode("d.path").alias("ord", "p"))
    return p.select("regionId", "contour", "index", "ord", F.col("p")[0].alias("px"), F.col("p")[1].alias("py"))


def metadata(df: DataFrame, col: str = "doc") -> Column:
    """Map of the kept keys, first letter upper-cased."""
    m = F.from_json(col, "MAP<STRING, STRING>")
    m = F.map_filter(m, lambda k, _: k.isin(*METADATA_KEYS))
    return F.transform_keys(m, lambda k, _: F.concat(F.upper(F.substring(k, 1, 1)), F.substring(k, 2, 1000)))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """One name per line, blanks dropped."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


def complete_units(paths: DataFrame, needed=("regionfile", "label.json")) -> DataFrame:
    """Folders that hold every needed file, from a listing of paths."""
    name = F.substring_index("path", "/", -1)
    unit = F.substring_index(F.regexp_replace("path", "/[^/]*$", ""), "/", -1)
    return paths.select(unit.alias("unit"), name.alias("name")).where(F.col("name").isin(*needed)).groupBy("unit").agg(
        F.countDistinct("name").alias("found")).where(F.col("found") == len(needed)).select("unit")


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Cases without a stored result."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
