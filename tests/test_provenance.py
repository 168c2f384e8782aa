"""Provenance of every step of the composed extraction against numpy."""

import numpy as np
import pytest

from voxelframe.operators import extract

CELL = "case_id int, z int, y int, x int, v double, m int"


def test_steps(spark):
    """Two parts of a mask, a resampled image by a spline, a resegmented mask; the order of rows does not matter."""
    rng = np.random.default_rng(8)
    v = rng.normal(10, 3, (4, 5, 6))
    m = np.zeros((4, 5, 6), int)
    m[:2, :, :2], m[2:, :, 4:] = 1, 1
    rows = [(1, z, y, x, float(v[z, y, x]), int(m[z, y, x])) for z, y, x in np.ndindex(*v.shape)]
    s = extract.Settings(spacing=(2.0, 1.0, 1.0), new_spacing=(1.0, 1.0, 1.0), interpolator="spline", min_cells=3, resegment=(8.0, None, "absolute"),
                         classes=("firstorder",), names={"firstorder": ("Mean",)}, plugins=False)

    def run(rs):
        return {r.feature: r.value for r in extract.compose(spark.createDataFrame(rs, CELL), s).collect() if r.image_type == "diagnostics"}

    got = run(rows)
    z, y, x = np.nonzero(m)
    assert [got[f"Image-original_Size_{a}"] for a in "zyx"] == [4, 5, 6] and [got[f"Image-interpolated_Size_{a}"] for a in "zyx"] == [8, 5, 6]
    assert got["Image-original_Dimensionality"] == 3 and got["Image-original_Mean"] == pytest.approx(v.mean())
    assert got["Mask-original_VoxelNum"] == len(z) == 40 and got["Mask-interpolated_VoxelNum"] == 80
    assert got["Mask-original_VolumeNum"] == 2 and got["Mask-interpolated_VolumeNum"] == 2
    assert [got[f"Mask-original_BoundingBox_{a}"] for a in ("z", "y", "x", "nz", "ny", "nx")] == [0, 0, 0, 4, 5, 6]
    assert got["Mask-original_CenterOfMassIndex_z"] == pytest.approx(z.mean()) and got["Mask-original_CenterOfMass_z"] == pytest.approx(2 * z.mean())
    assert [got[f"Mask-{k}_Spacing_z"] for k in ("original", "interpolated", "resegmented")] == [2, 1, 1]
    assert got["Mask-resegmented_Minimum"] >= 8 and 0 < got["Mask-resegmented_VoxelNum"] < 80
    assert got["Mask-original_Maximum"] == pytest.approx(v[m == 1].max())
    for part in ("High", "Low"):
        assert 0 <= got[f"Image-original_Hash_{part}"] < 2 ** 32
    back = run(rows[::-1])
    assert back.keys() == got.keys() and all(back[k] == pytest.approx(got[k]) for k in got)
    assert back["Image-original_Hash_Low"] == got["Image-original_Hash_Low"]
    changed = run([(*rows[0][:4], rows[0][4] + 1e-9, rows[0][5]), *rows[1:]])
    assert (changed["Image-original_Hash_High"], changed["Image-original_Hash_Low"]) != (got["Image-original_Hash_High"], got["Image-original_Hash_Low"])
