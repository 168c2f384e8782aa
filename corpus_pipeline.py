"""Documents to packed training sequences, in five stages; each is written as Parquet and read again for the next.

What a stage stages for itself is deleted when the next one starts: by then its result has been written. If a stage fails,
at once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm import jaccard, langid, packing, pii, substrings
from voxelframe.llm.common import collected, delete, read, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []  # folders that the stage before has staged


def tidy(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, _left)
        with collected(spark) as folders:
            out = stage(spark, docs, sf_dir)
        _left.extend(folders)
        return out
    return run


def sized(docs: DataFrame) -> DataFrame:
    """n_chars as the texts are now, where documents have that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


@tidy
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or whose language is a toss-up; learns from the labelled ones, and raises if none is."""
    model = langid.fit(docs, F.lit(True))
    if not model and not docs.isEmpty():
        raise ValueError("no labelled document to learn languages from")
    return langid.accepted(docs, model)


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each component of near duplicates, by id."""
    return jaccard.representatives(docs)


@tidy
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out words in windows of 20 that start earlier as well; a text without any is not touched."""
    return sized(substrings.shortened(docs))


@tidy
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data by the name of its kind."""
    return sized(pii.masked(docs))


@tidy
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("PII", personal_data),
          ("best-fit packing", sequences)]

ORACLE_SQL = None  # compression, personal data beyond patterns and tokenizers have no SQL; tests/llm compares with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with collected(spark) as written:
            docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        delete(spark, before)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
