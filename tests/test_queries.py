"""Every registered query against its SQL on the smallest supplied tables."""

import collections

import duckdb
import pytest

from ledgerloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "conversations", "benchmark", "embeddings", "labels")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.execute(f"select {', '.join(columns)} from ({registry.SQL[name]})").fetchall()
    assert collections.Counter(map(repr, map(tuple, df.select(*columns).collect()))) == collections.Counter(map(repr, want))


def test_filters_and_columns_reach_the_scan(spark):
    plan = lambda name: registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Contains(text,nterti)" in plan("contains_filter").replace("StringContains", "Contains")
    assert "struct<doc_id:bigint,text:string>" in plan("sentences")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["kw_topic1", "esg_topic", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
