import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tessera.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    cols = sorted(df.columns)
    out = [tuple(None if v is None or (not isinstance(v, list) and pd.isna(v)) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).replace(" 00:00:00", "") for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None)]
    return cols, sorted(out, key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    assert rows(plans.QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(plans.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries()) and set(plans.SQL) <= set(entry.oracle_sql())


def test_plan_has_no_shuffle_or_python(spark, sf):
    """A pattern scan is one pass over two columns."""
    from tessera.plans import jobs

    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("cast(doc_id as string) as document_id", "text")
    plan = jobs.scan_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
