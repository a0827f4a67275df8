"""Every query runs on the small tables with a stable schema; the SQL comparison is on a few of each family."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = ["rolling_mean", "ema", "asof_join", "stack_sync", "concat", "concat_sync", "financial_ratios", "winsorize", "rank_linear", "forward_adjust", "financial_reports", "drawdown", "ols_expanding"]


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    key = lambda r: tuple((v is None, 0 if v is None else v) for v in r)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    want = sorted(duck.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({entry.oracle_sql()[name]})").fetchall(), key=key)
    assert got == want and got


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
