"""Agent tools, ranking without vectors, settings, notes and run logs."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from daybook.operators import search, stats
from daybook.operators.tools import BadParameter, Tools
from daybook.sources import agents, sinks

AT = datetime.datetime(2024, 1, 15, 10)


@pytest.fixture(scope="module")
def tools(spark):
    rows = [(i, AT + datetime.timedelta(minutes=i), "app", "coding", f"s{i}", f"text {i} needle" if i % 2 else "", "ok" if i % 3 else "failed", i == 4, [1.0, 0.0] if i % 4 else None, f"/shots/{i}.jpg" if i else None) for i in range(8)]
    a = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, app_name string, category string, summary string, ocr_text string, status string, bookmarked boolean, embedding array<float>, screenshot_path string").withColumn("date", F.col("timestamp").cast("date"))
    c = spark.createDataFrame([], "id long, activity_id long, repo_name string")
    m = spark.createDataFrame([(1, AT, "Meet", 5.0, "about the needle", None)], "id long, start_time timestamp_ntz, app_name string, duration_minutes double, transcript string, summary string")
    return Tools(a, c, m, embed=lambda _: [1.0, 0.0])


def said(df):
    return json.loads(df.first()["json"])


def test_answers(tools):
    recent = said(tools.recent_activity(3))
    assert recent["count"] == 3 and [x["id"] for x in recent["activities"]] == [7, 5, 4]
    found = said(tools.search_screen("needle"))
    assert found["query"] == "needle" and {x["id"] for x in found["results"]} == {1, 2, 5, 7} and found["results"][0]["match"] == "semantic"
    assert [x["id"] for x in said(tools.activity_by_time("2024-01-15", 10, 10))["activities"]] == [1, 2, 4, 5, 7]
    assert said(tools.activity_by_time("2024-01-16"))["count"] == 0
    assert said(tools.search_audio("NEEDLE"))["results"][0]["snippet"] == "about the needle"
    assert {"metric": "total", "key": "", "value": 5.0} in said(tools.statistics("2024-01-20"))["statistics"]
    assert tools.screenshot(3, "/shots") == "/shots/3.jpg"


def test_parameters_are_checked(tools):
    for call in (lambda: tools.activity_by_time("15.1.2024"), lambda: tools.activity_by_time("2024-01-15", 24), lambda: tools.search_screen("x", 0), lambda: tools.statistics("today"), lambda: tools.screenshot(0, "/shots"), lambda: tools.recent_activity(0)):
        with pytest.raises(BadParameter):
            call()


def test_rerank_without_vectors_keeps_the_order(spark):
    rows = [(1, AT, None, 2), (2, AT, None, 0), (3, AT, None, None), (4, AT + datetime.timedelta(1), None, None), (5, AT, None, 1), (6, AT, None, 3)]
    some = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, embedding array<float>, place int")
    out = search.rerank(some, [1.0], "2024-01-20 00:00:00", 25).collect()
    assert [(r["id"], r["relevance"]) for r in out] == [(2, 0.5), (5, 0.5), (1, 0.5), (6, 0.5), (4, 0.5)]


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    allowed = {"interval": (int, lambda x: 5 <= x <= 300), "name": str, "on": bool}
    assert agents.settings(path, allowed) == {}
    assert agents.save_settings(path, {"interval": 40, "name": "x", "on": "yes", "other": 1}, allowed) == {"interval": 40, "name": "x"}
    assert agents.save_settings(path, {"interval": 4, "on": True}, allowed) == {"interval": 40, "name": "x", "on": True}
    assert agents.settings(path, {"interval": int}) == {"interval": 40}
    (tmp_path / "s.json").write_text("[1]")
    assert agents.settings(path, allowed) == {}


def test_notes_outputs_and_logs(spark, tmp_path):
    notes = str(tmp_path / "notes")
    days = spark.createDataFrame([(datetime.date(2024, 1, 2), "sum", "stand", 3), (datetime.date(2024, 1, 3), None, "", 0)], "date date, summary string, standup string, total_activities long")
    sinks.write_notes(days, notes)
    assert sorted(p.name for p in (tmp_path / "notes").iterdir()) == ["2024-01-02.md", "2024-01-03.md"]
    assert "## Standup\n\nstand" in (tmp_path / "notes/2024-01-02.md").read_text() and "Standup" not in (tmp_path / "notes/2024-01-03.md").read_text()
    outputs = str(tmp_path / "outputs")
    late = AT + datetime.timedelta(seconds=30)
    said = [("daily", AT, "body"), ("daily", late, "later"), ("weekly", datetime.datetime(2024, 1, 2, 3, 4), "all\nof it"), ("weekly", AT, None)]
    sinks.write_agent_outputs(spark.createDataFrame(said, "slug string, at timestamp_ntz, text string"), outputs)
    assert (tmp_path / "outputs/weekly/2024-01-02_03-04.md").read_text() == "# weekly \u2014 2024-01-02_03-04\n\nall\nof it"
    assert (tmp_path / "outputs/daily/2024-01-15_10-00.md").read_text().endswith("\n\nlater")
    found = agents.outputs(spark, f"{outputs}/weekly", newest=1).collect()
    assert [(r["file"], r["total"]) for r in found] == [("2024-01-15_10-00.md", 2)] and found[0]["size"] == len(found[0]["text"].encode())
    log = tmp_path / "log.json"
    log.write_text("\n".join(json.dumps({"id": i, "agent": "a", "timestamp": f"2024-01-01T00:00:{i:02d}", "status": "ok"}) for i in range(40)))
    assert [r["id"] for r in agents.run_log(spark, str(log)).collect()] == list(range(39, 9, -1))
    files = spark.read.format("binaryFile").load(str(log))
    assert tuple(stats.disk_usage(files).first()) == (1, log.stat().st_size)
    sinks.register(spark, {"days_seen": days})
    assert spark.sql("select count(*) as n from days_seen").first()["n"] == 2
