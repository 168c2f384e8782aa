import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from voxelframe.session import tune

    s = (SparkSession.builder.master("local[4]").appName("tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield tune(s)
    s.stop()


GRID_A = [[5, 2, 5, 4, 4], [3, 3, 3, 1, 3], [2, 1, 1, 1, 3], [4, 2, 2, 2, 3], [3, 5, 3, 3, 2]]
GRID_B = [[1, 2, 5, 2], [3, 5, 1, 3], [1, 3, 5, 5], [3, 1, 1, 1]]


@pytest.fixture(scope="session")
def grid_levels(spark):
    """Cells whose level is already known: (case_id, bin_count, z, y, x, g, v, m)."""
    def make(rows, case=0):
        data = [(case, 5, 0, y, x, g, float(g), 1) for y, r in enumerate(rows) for x, g in enumerate(r) if g]
        return spark.createDataFrame(data, "case_id long, bin_count int, z int, y int, x int, g int, v double, m int")
    return make
