"""Every query with an oracle against DuckDB on the smallest tables; the others must run."""

import duckdb
import pandas as pd
import pytest

from scriptorium.plans import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].astype(object).where(df[c].notna(), None)
    return sorted(map(tuple, df.values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = q.QUERIES[name](spark, sf_dir).toPandas()
    if name in q.ORACLES:
        want = duck.execute(q.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_resolve_id_reads_all_parts(spark, sf_dir):
    plan = q.QUERIES["resolve_id"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "p_partkey" in plan and "150" not in plan
