"""Feature naming."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: short forms used in parameterised feature names
SHORT = (("suffix", "f"), ("True", "1"), ("False", "0"), ("percent", "p"), ("inverse", "inv"))


def snake(name: str) -> str:
    """MeanAbsoluteDeviation -> mean_absolute_deviation; 25Percentile -> p25."""
    m = re.fullmatch(r"(\d+)Percentile", name)
    if m:
        return f"p{m.group(1)}"
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def parameterised(cls, feature, bins=None, dist=None, variant=None) -> Column:
    """<class>_<Feature>[_b_<bins>][_d_<dist>][_<variant>] with the short forms applied."""
    parts = [F.lit(c) if isinstance(c, str) else c for c in (cls, feature)]
    for tag, c in (("b", bins), ("d", dist)):
        if c is not None:
            parts.append(F.when(c.isNotNull(), F.concat(F.lit(f"{tag}_"), c.cast("string"))))
    if variant is not None:
        parts.append(F.when(variant != "value", variant))
    out = F.concat_ws("_", *parts)
    for long, short in SHORT:
        out = F.regexp_replace(out, long, short)
    return out


def rotate(name: Column) -> Column:
    """a_b_c -> b_c_a."""
    return F.regexp_replace(name, "^([^_]+)_(.*)$", "$2_$1")


# fixed value: first part of a feature's group path
GROUP_ROOT = "radiomics"


def group_path(name: Column) -> Column:
    """<root>/<part1>/<part2>."""
    return F.concat_ws("/", F.lit(GROUP_ROOT), F.array_join(F.slice(F.split(name, "_"), 1, 2), "/"))
