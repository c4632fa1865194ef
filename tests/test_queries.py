"""The registered core queries: against their SQL, their plans, and their independence of the optional subpackage."""

from __future__ import annotations

import ast
import datetime as dt
import os
from pathlib import Path

import pytest

from larkspur.plans import registry

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    answer = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    frame = registry.queries()[name](spark, DATA)
    assert sorted(frame.columns) == sorted(columns)
    got = sorted((tuple(plain(v) for v in r) for r in frame.select(*columns).collect()), key=repr)
    assert got == sorted((tuple(plain(v) for v in r) for r in answer.fetchall()), key=repr)


@needs_data
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_plans_hold_no_cross_join(spark, name):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@needs_data
def test_scans_read_only_what_is_needed(spark):
    def plan(name):
        return registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()

    assert "ReadSchema: struct<id:bigint,title:string>" in plan("autocomplete_vocab")
    assert "ReadSchema: struct<id:bigint,preprocessed_text:string>" in plan("tfidf_weights")
    assert "EqualTo(type,story)" in plan("source_story_filter")
    assert "TakeOrderedAndProject" in plan("tfidf_topk") and "TakeOrderedAndProject" in plan("top_searches")


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_nothing_outside_imports_the_optional_subpackage():
    for file in (ROOT / "larkspur").rglob("*.py"):
        if (ROOT / "larkspur" / "llm") in file.parents:
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), file


@needs_data
def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
