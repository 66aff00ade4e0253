"""The query registry and its reference SQL."""

import duckdb
import pytest

from sonorisk.plans import load_all

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REG = load_all()


def test_every_oracle_has_a_query():
    assert set(REG.ORACLES) <= set(REG.QUERIES) and len(REG.QUERIES) >= 250


@pytest.mark.parametrize("key", ["ENTRY", "AGG04", "WIN10", "FN21", "JOB10", "TOP05", "WIN16", "JON11", "FLT05"])
def test_query_agrees_with_sql(spark, sf, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = REG.QUERIES[key](spark, sf)
    cur = con.execute(REG.ORACLES[key])
    names = [d[0] for d in cur.description]
    want = sorted(str([r[names.index(c)] for c in df.columns]) for r in cur.fetchall())
    assert sorted(str(list(r)) for r in df.collect()) == want


@pytest.mark.parametrize("key", ["WIN01", "WIN02", "AGG04", "AGG34", "AGG39", "JON11", "TOP05", "TOP11", "WIN03", "WIN10", "WIN13"])
def test_spread_plan_agrees_with_sql(spark, sf, key, monkeypatch):
    """Every size switch forced to the plan for large inputs."""
    from sonorisk import scale

    monkeypatch.setattr(scale, "SINGLE_TASK_BYTES", -1)
    test_query_agrees_with_sql(spark, sf, key)


@pytest.mark.parametrize("key", ["JON01", "JON17", "JON18", "JON24", "FLT08", "JON03"])
def test_literal_tables_do_not_shuffle_the_facts(spark, sf, key):
    plan = REG.QUERIES[key](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
