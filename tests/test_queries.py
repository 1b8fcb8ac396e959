"""Every query beside its SQL, on the smallest tables; and the shape of the plans."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point

QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in os.listdir(data):
        c.sql(f"create view {t.split('.')[0]} as select * from read_parquet('{data}/{t}')")
    return c


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in SQL))
def test_query_equals_sql(spark, data, duck, tmp_path, name):
    QUERIES[name](spark, data).write.parquet(f"{tmp_path}/out")
    duck.sql(f"create or replace table want as {SQL[name]}")
    duck.sql(f"create or replace table got as select * from '{tmp_path}/out/*.parquet'" if any(f.endswith(".parquet") for f in os.listdir(f"{tmp_path}/out")) else "create or replace table got as select * from want limit 0")
    cols = sorted(r[0] for r in duck.sql("describe want").fetchall())
    assert cols == sorted(r[0] for r in duck.sql("describe got").fetchall())
    c = ", ".join(cols)
    for x, y in (("want", "got"), ("got", "want")):
        assert duck.sql(f"select {c} from {x} except all select {c} from {y} limit 3").fetchall() == []


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["feed_health", "due_captures", "due_polls", "dispositions", "reading_bodies", "p2_found", "blocked_versions"])
def test_no_cross_joins(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_are_pruned(spark, data):
    plan = QUERIES["head_versions"](spark, data)._jdf.queryExecution().toString()
    assert "content_hash" not in plan.split("Physical Plan")[1]
