"""Every query that has an oracle gives the oracle's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from specforge.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v).lower()

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_oracle(spark, sf_dir, duck, name):
    got, want = catalogue.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_without_oracle(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() >= 0


def test_contract(spark):
    assert entry.entry(spark).columns == ["category", "n", "pct"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
