"""Registered queries against their SQL twins on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, norm

SF = "/root/testdata/sf0.001"
KEYS = ("tx_glcm_prob", "glcm_contrast", "fo_median", "tx_gldm_counts", "tx_ngtdm_table", "win_runs", "vx_bin_count", "vx_wavelet",
        "shape_volume", "src_json_table", "sink_json_lines", "jn_left_last_wins", "jn_knn", "win_mean_roc", "pp_impute", "sel_anova_f",
        "ev_class_report", "ex_label_override")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_catalog():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 300


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, duck, key):
    df = entry.queries()[key](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(v) for v in r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    cur = duck.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    idx = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(norm(r[i]) for i in idx)) for r in cur.fetchall())
