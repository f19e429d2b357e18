"""Every registered query with an oracle matches DuckDB at sf0.001 (fast slice of the driver's gate)."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, rows

SF = "/root/testdata/sf0.001"
SLOW = {"mask_rate_search", "dual_process_loop"}
NAMES = [n for n in E.oracle_sql() if n not in SLOW]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF).toPandas()
    odf = con.execute(E.oracle_sql()[name]).df()
    sc, sr = rows(sdf)
    oc, orr = rows(odf)
    assert sc == oc
    assert sr == orr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "pred_mask_size" in df.columns
