"""Every registered core query against its SQL, on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
DIR = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def _rounded(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


def test_core_queries_agree_with_sql(spark, duck):
    from veilspan.plans.oracle import ORACLE_SQL
    from veilspan.plans.queries import QUERIES

    assert set(ORACLE_SQL) < set(QUERIES)
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, DIR)
        columns = sorted(df.columns)
        mine = sorted((_rounded(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)
        theirs = duck.execute(sql)
        names = [c[0] for c in theirs.description]
        assert sorted(names) == columns, name
        rows = sorted((_rounded(r[names.index(c)] for c in columns) for r in theirs.fetchall()), key=repr)
        assert mine == rows, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_detection_needs_no_exchange(spark):
    from veilspan.plans.engine import Engine
    from veilspan.settings import Settings

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    plan = Engine(Settings()).redact(docs, mode="mask").select("doc_id", "redacted_text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "n_chars" not in plan.split("ReadSchema")[-1]
