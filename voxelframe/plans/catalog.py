"""Catalog of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelframe.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(key: str, fn: Query, oracle: str | None = None) -> None:
    if key in QUERIES:
        raise ValueError(f"duplicate query key {key}")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[key] = run
    if oracle is not None:
        ORACLES[key] = oracle


def query(key: str, oracle: str | None = None):
    def wrap(fn: Query) -> Query:
        register(key, fn, oracle)
        return fn

    return wrap


def r6(expr: str, digits: int = 6) -> str:
    """SQL text of functions.numeric.r6: rounded away from ties, coarser for large values."""
    x = f"({expr})"
    nudge = f"1e-{digits + 4}"
    return (f"(CASE WHEN abs{x} < 1e4 THEN round({x} + {nudge}, {digits}) "
            f"WHEN abs{x} < 1e8 THEN round({x} + 1e-5, 2) ELSE round({x} + 0.01, 0) END + 0.0)")
