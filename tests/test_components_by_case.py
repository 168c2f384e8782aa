"""Components of keys that fit a task are found there, without rounds over all of them."""

import pytest
from pyspark.sql import functions as F

from voxelframe.operators import components, grid


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(c, f"s{c % 2}", z, y, x, (z * 3 + y * 5 + x * 7 + c) % 3) for c in range(5) for z in range(4) for y in range(5) for x in range(6)
            if (5 * z + 3 * y * y + x * x * 7 + c) % (2 + c) == 0]
    rows += [(7, "s", 0, x % 2 * 0, x, 1) for x in range(40)] + [(8, "s", 0, 0, 0, 1), (8, "s", 0, 0, 1, 2), (8, "s", 0, 0, 1, 1), (8, "s", 0, 9, 9, 1)]
    return spark.createDataFrame(rows, "case_id long, step string, z int, y int, x int, g int").withColumn("case_id", F.struct("case_id"))


def searched(rows, same):
    """A plain search from every cell."""
    at = {}
    for r in rows:
        at.setdefault((r["case_id"], r["step"]), {}).setdefault((r["z"], r["y"], r["x"]), set()).add(r["g"])
    out = {}
    for key, found in at.items():
        left = set(found)
        while left:
            part, todo = set(), [left.pop()]
            while todo:
                p = todo.pop()
                part.add(p)
                for q in [q for q in left if max(abs(a - b) for a, b in zip(p, q)) == 1 and (not same or found[p] & found[q])]:
                    left.discard(q)
                    todo.append(q)
            out.update({(key, p): min(part) for p in part})
    return out


@pytest.mark.parametrize("same", (None, "g"))
@pytest.mark.parametrize("limit", (0, 25, 1 << 17))
def test_components_against_a_plain_search(spark, cells, monkeypatch, same, limit):
    monkeypatch.setattr(components, "LOCAL_CELLS", limit)
    got = components.components(cells, ["case_id", "step"], same)
    axes = grid.key_axes(F.col("comp"))
    rows = got.select("*", *[a.alias(n) for a, n in zip(axes, ("cz", "cy", "cx"))]).collect()
    assert len(rows) == cells.count() and set(cells.columns) | {"comp"} == set(got.columns)
    want = searched(cells.collect(), same)
    for r in rows:
        assert (r["cz"], r["cy"], r["cx"]) == want[(r["case_id"], r["step"]), (r["z"], r["y"], r["x"])]


def test_small_keys_take_no_rounds(cells, monkeypatch):
    monkeypatch.setattr(components, "contract", lambda edges: pytest.fail("a round over all keys"))
    assert components.components(cells, ["case_id", "step"]).count() == cells.count()
    assert components.components(cells.where("g > 5"), ["case_id", "step"]).count() == 0
