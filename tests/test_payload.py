"""Agent payloads, SQL functions and plug-ins."""

import datetime

import pytest

from daybook.operators.payload import day_payload
from daybook.plans import registry


@pytest.fixture(scope="module")
def day(spark):
    at = datetime.datetime(2024, 1, 5, 9)
    rows = [(i, at + datetime.timedelta(minutes=i), at.date(), "ok" if i % 5 else "failed", f"app{i % 2}", "coding", f"work {i}", "https://Ex.org/p" if i % 3 == 0 else None, "neutral") for i in range(20)]
    a = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, date date, status string, app_name string, category string, summary string, active_url string, mood string")
    m = spark.createDataFrame([(1, at, "Zoom", 30.0, None)], "id long, start_time timestamp_ntz, app_name string, duration_minutes double, summary string")
    return a, m


def test_sections_and_budget(spark, day):
    text = day_payload(*day).first()["text"]
    assert text.startswith("## Data of 2024-01-05\n\n16 rows analysed\n\n### Apps\napp0: 8, app1: 8\n\n### Categories\ncoding: 16\n\n### URLs\n- ex.org (5x) https://Ex.org/p\n\n### Meetings\n- 09:00 Zoom (30.0min): No summary\n\n### Moods\nneutral: 16\n\n### Timeline\n[09:19] app1 (coding): work 19\n[09:18] app0 (coding): work 18 [ex.org]")
    assert text.count("\n[") == 16
    small = day_payload(*day, budget=200).first()["text"]
    assert "### Apps" in small and small.count("\n[") <= 3
    assert "### Moods" not in day_payload(*day, sections=("timeline",)).first()["text"]


def test_sql_functions(spark):
    registry.register_functions(spark)
    r = spark.sql("select journal_tokens('Été a-1') t, journal_hamming(5, 6) h, journal_card_ok('4111 1111 1111 1111') c, journal_dot(array(float(1), float(2)), array(float(3), float(4))) d").first()
    assert (r.t, r.h, r.c, r.d) == (["ete", "a", "1"], 2, True, 11.0)


def test_plugins(spark):
    registry.plugin("n")(lambda spark, context: spark.range(context["n"]))
    assert registry.run_plugin(spark, "n", {"n": 3}, {"n"}).count() == 3
    with pytest.raises(PermissionError):
        registry.run_plugin(spark, "n", {"n": 3}, set())


def test_agent_files_select_sections(spark, day, tmp_path):
    from daybook.operators.payload import agent_payloads
    from daybook.sources import agents

    (tmp_path / "mood.md").write_text("---\nname: M\ndata: Mood , apps\n---\nHow was it?")
    (tmp_path / "plain.md").write_text("Tell me.")
    (tmp_path / "big.md").write_text("---\ndata: meetings\nmodel_requirement: 9000\n---\nLong.")
    (tmp_path / "off.md").write_text("---\nenabled: no\n---\nx")
    (tmp_path / "plug.py").write_text('"""\nname: Plug\n"""')
    found = {r["slug"]: r for r in agent_payloads(agents.discover(spark, str(tmp_path)), *day, 4096).collect()}
    heads = {k: [x.split("\n")[0] for x in r["text"].split("### ")[1:]] for k, r in found.items()}
    assert heads == {"mood": ["Apps", "Categories", "Moods"], "plain": ["Apps", "Categories", "Timeline"], "big": ["Meetings"]}
    assert found["mood"]["text"] == day_payload(*day, sections=("apps", "mood")).first()["text"]
    assert found["mood"]["prompt"] == "How was it?" and {k: r["small_window"] for k, r in found.items()} == {"mood": False, "plain": False, "big": True}
    assert agent_payloads(agents.discover(spark, str(tmp_path)).where("slug = 'off'"), *day, 4096).count() == 0


def test_table_plugins(spark, day):
    with pytest.raises(PermissionError):
        registry.register_plugin(spark, "s", registry.Streaks, set())
    registry.register_plugin(spark, "s", registry.Streaks, {"s"})
    day[0].withColumnRenamed("mood", "who").createOrReplaceTempView("plugged")
    rows = spark.sql("select * from s(TABLE(plugged), key => 'who') order by start").collect()
    assert len(rows) == 20 and rows[0].asDict().keys() == {"who", "app_name", "start", "end", "n"} and {r["n"] for r in rows} == {1}
    with pytest.raises(Exception, match="needs the columns nothing"):
        spark.sql("select * from s(TABLE(plugged), key => 'nothing')").collect()

