"""Pluggable features and image filters.

A feature is a function returning an aggregate Column over a named cell table; a filter is a function
DataFrame -> DataFrame on the voxel table. Registering one makes it part of every extraction.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Feature:
    name: str
    table: str
    build: Callable[[], Column]
    deprecated: bool = False


FEATURES: dict[str, Feature] = {}
FILTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def feature(name: str, table: str = "roi", deprecated: bool = False):
    def wrap(fn: Callable[[], Column]):
        FEATURES[name] = Feature(name, table, fn, deprecated)
        return fn

    return wrap


def image_filter(name: str):
    def wrap(fn: Callable[[DataFrame], DataFrame]):
        FILTERS[name] = fn
        return fn

    return wrap


def enabled(table: str = "roi", names=None) -> list[Feature]:
    """Named features of a table; without names all that are not deprecated."""
    return [f for f in FEATURES.values() if f.table == table and (f.name in names if names else not f.deprecated)]


def apply(df: DataFrame, keys, table: str = "roi", names=None) -> DataFrame:
    return df.groupBy(*keys).agg(*[f.build().alias(f.name) for f in enabled(table, names)])


def null_if_bad(col: Column) -> Column:
    """A failed feature (division by zero, log of zero, overflow) is NULL."""
    return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)
