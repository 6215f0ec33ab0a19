import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from readloom.plans import driver

SF = "/root/testdata/sf0.001"


def rows(df):
    cols = sorted(df.columns)
    plain = lambda x: None if pd.isna(x) else int(x) if isinstance(x, float) and x.is_integer() else x
    return sorted((tuple(map(plain, r)) for r in df[cols].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", [n for n in driver.QUERIES if n in driver.ORACLES])
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("lineitem", "part"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(driver.QUERIES[name](spark, SF).toPandas()) == rows(c.execute(driver.ORACLES[name]).fetchdf())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
