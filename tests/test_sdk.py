"""The data functions by name."""

import datetime
import json

import pytest

from daybook.operators import context
from daybook.operators.sdk import FUNCTIONS, Journal

AT = datetime.datetime(2024, 1, 15, 10)


@pytest.fixture(scope="module")
def journal(spark, tmp_path_factory):
    rows = [(i, AT + datetime.timedelta(minutes=i), ("Edge", "Code")[i % 2], ("browsing", "coding")[i % 2], f"s{i}", f"text {i}", "ok" if i % 3 else "failed", i == 4, f"https://x.org/{i % 4}" if i % 2 == 0 else None) for i in range(12)]
    a = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, app_name string, category string, summary string, ocr_text string, status string, bookmarked boolean, active_url string").selectExpr("*", "cast(timestamp as date) as date")
    m = spark.createDataFrame([(1, AT, "Zoom", 5.0, "said", None), (2, AT - datetime.timedelta(days=1), "Zoom", 1.0, "", "")], "id long, start_time timestamp_ntz, app_name string, duration_minutes double, transcript string, summary string")
    s = spark.createDataFrame([(AT.date(), "a day")], "date date, summary string")
    return Journal(a, m, s, "2024-01-15 10:11:00", find=lambda q, n: a.where(a["summary"] == q).limit(n), folder=str(tmp_path_factory.mktemp("out")), settings={"model": "m", "secret": "x"})


def test_every_function_by_name(journal):
    given = {"get_activities_by_date": {"date_str": "2024-01-15"}, "search": {"query": "s3"}, "write_file": {"path": "a/b.txt", "content": "said"}}
    found = {name: journal.call(name, **given.get(name, {})) for name in FUNCTIONS}
    rows = {name: df.collect() for name, df in found.items() if df is not None}
    assert [r["id"] for r in rows["search"]] == [3] and len(rows["get_recent_activity"]) == 12
    assert [(r["url"], r["count"], r["app"], r["summary"]) for r in rows["get_urls_visited"]] == [("https://x.org/0", 3, "Edge", "s8"), ("https://x.org/2", 3, "Edge", "s10")]
    assert sorted((r["app_name"], r["captures"], r["categories"]) for r in rows["get_app_usage"]) == [("Code", 6, "coding"), ("Edge", 6, "browsing")]
    assert [r["id"] for r in rows["get_meetings"]] == [1] and rows["get_summary"][0]["summary"] == "a day"
    assert json.loads(rows["status"][0]["json"]) == {"model": "m", "capture_interval": None, "performance_mode": None, "analysis_mode": None, "capture_active_monitor": None, "data_path": None}
    assert open(f"{journal.folder}/a/b.txt").read() == "said"
    with pytest.raises(KeyError):
        journal.call("now")
    with pytest.raises(Exception):
        journal.write_file("../b", "x")


def test_filters(journal):
    assert [r["id"] for r in journal.get_activities(app="Code", limit=2).collect()] == [11, 9]
    assert {r["id"] for r in journal.get_activities(url_contains="x.org/2").collect()} == {2, 6, 10}
    assert journal.get_activities(date="2024-01-14").count() == 0 and journal.get_summary("2024-01-01").first()["summary"] == ""
    assert [r["id"] for r in journal.get_recent_activity(3).collect()] == [11, 10, 9, 8]


def test_standup(journal):
    from pyspark.sql import functions as F

    rows = journal.activities.withColumn("organized_text", F.when(F.col("id") % 2 == 0, F.repeat(F.lit("ab"), 150)))
    text = context.standup(rows, 4096, rich=1).first()["text"].split("\n")
    assert text == ["- Code: s11", "- Edge: s10", "  Content: " + "ab" * 100 + "...", "- Edge: s8", "- Code: s7", "- Code: s5", "- Edge: s4", "- Edge: s2", "- Code: s1"]
    assert context.standup_budget(4096) == 7866
    assert context.standup(rows, 700).count() == 1
