"""Shared pieces: selecting the id and text columns, staging in the shared folder, Arrow batches by size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.session import scratch_path

SLICE_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text, under fixed names: other columns cannot clash with an operator's own."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings (dots as two underscores) for the jobs inside; restored afterwards."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_scopes: list[list[str]] = []  # folders of the staged tables of each scope that is open, innermost last


def delete(spark: SparkSession, folders: list[str]) -> None:
    """Removes staged folders, through Hadoop's file system, and forgets them."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    while folders:
        path = hadoop.Path(folders.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def collected(spark: SparkSession) -> Iterator[list[str]]:
    """The folders staged inside, for the caller to delete; deleted at once if what is inside fails."""
    folders: list[str] = []
    _scopes.append(folders)
    try:
        yield folders
    except BaseException:
        delete(spark, folders)
        raise
    finally:
        _scopes.pop()


@contextmanager
def intermediate(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables staged inside go at the end, but for those staged by the function it gives (they belong to the scope outside)."""
    with collected(spark) as folders:
        inner = _scopes[-1]

        def keep(df: DataFrame, name: str) -> DataFrame:
            before = set(inner)
            out = staged(df, name)
            mine = [f for f in inner if f not in before]
            for f in mine:
                inner.remove(f)
                if len(_scopes) > 1:
                    _scopes[-2].append(f)
            return out

        yield keep
    delete(spark, folders)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage and survives lost executors.

    The shuffle files behind it go as soon as it is written. Arrow batches are small, to spare the Python workers' memory.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true",
                  spark__sql__execution__arrow__maxRecordsPerBatch="2000"):
        if _scopes:
            _scopes[-1].append(path)
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """Rows with a number, staged: numbers given at each scan would change with how Spark packs the files."""
    return staged(df.select(F.monotonically_increasing_id().alias(name), "*"), "numbered")


def crc_mod(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids give null."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to about max_bytes each (one row at least), so that a task's memory does not follow the row count."""
    for batch in batches:
        rows = max(1, batch.num_rows * max_bytes // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str) -> DataFrame:
    """fn on every slice of the partitions; fn returns columns by name in the order of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    types = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = fn(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in types], schema=types)

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hashes of words (bytes), those met last remembered up to a bound."""

    REMEMBERED, SHORT = 60_000, 48

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.SHORT:
            if len(self) >= self.REMEMBERED:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


HASHES = WordHashes()  # per worker


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer: every bit of the result depends on every bit of h."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every window of `width` hashes: a polynomial modulo 2^64 with an odd base chosen by the seed, finalized."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base, out = np.uint64(xxhash.xxh3_64_intdigest(b"base", seed) | 1), np.zeros(n, np.uint64)
    for k in range(width):
        out = out * base + h[k:k + n]
    return mixed(out)


LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z to a-z, byte by byte
