"""Registered queries against their SQL on the smallest tables, and plans."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from daybook.plans import catalogue
from daybook.sources.tables import activities

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def shown(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
    if name not in catalogue.ORACLES:
        assert rows
        return
    got = db.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == names
    at = [got.columns.index(c) for c in names]
    assert rows == sorted(tuple(shown(r[i]) for i in at) for r in got.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    from daybook.operators import stats, timeline

    text = plan(stats.heatmap(activities(spark, SF)))
    assert "embedding" not in text and "ocr_text" not in text and "Python" not in text
    assert "TakeOrderedAndProject" in plan(timeline.recent(activities(spark, SF)))
    assert "WindowGroupLimit" in plan(timeline.latest_per(activities(spark, SF), "app_name"))
    day = plan(timeline.rewind(activities(spark, SF, "text"), "2024-01-15"))
    assert "DataFilters" in day and "2024-01-15" in day
    for name in ("bm25_term", "redact_text", "frame_dedup", "url_extract", "vector_topk", "webhook_routes"):
        assert "ArrowEvalPython" not in plan(catalogue.QUERIES[name](spark, SF)) and "BatchEvalPython" not in plan(catalogue.QUERIES[name](spark, SF))
