"""Driver contract, plan shape, and Spark-vs-DuckDB agreement on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL

import __spark_entry__ as entry_mod
from marktext.plans import queries, verify
from marktext.plans.oracle import ORACLE
from marktext.plans.queries import QUERIES

def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["total_words_analyzed"] > 0
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_products(spark, name, monkeypatch):
    monkeypatch.setattr(queries, "BPE_VOCAB", 280)       # plans do not depend on the size
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, name):
    rep = verify.compare(spark, SF_SMALL, {name})[name]
    assert "error" not in rep, rep
    assert rep["cols_match"] and rep["rows_match"] and rep["values_match"], rep


def test_scans_are_pruned(spark):
    plan = QUERIES["collision_summary"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "PushedFilters: [IsNotNull(doc_id)" in plan
    emb = QUERIES["embedding_group_cosine"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    # vec_id is read because small inputs are hash-spread by their key; nothing else is.
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in emb
