import duckdb
import pandas as pd
import pytest
from ledgerline.catalog import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        number = pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c])
        df[c] = df[c].astype(float) if number else df[c].map(lambda v: None if pd.isna(v) else str(v)[:19].replace(" 00:00:00", ""))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in REGISTRY.items() if sql))
def test_query_equals_its_sql(spark, duck, name):
    query, sql = REGISTRY[name]
    pd.testing.assert_frame_equal(plain(query(spark, SF).toPandas()), plain(duck.execute(sql).df()), check_dtype=False, rtol=0, atol=1e-9)


def test_plans_stay_in_the_jvm_and_push_down(spark):
    for name in ("a07_sharpe", "o08_waterfall", "o01_ledger_final", "w03_expanding_metrics", "l03_latest_run"):
        plan = REGISTRY[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    plan = REGISTRY["f01_equality"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan and "o_totalprice" not in plan
