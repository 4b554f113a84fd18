"""Searches by meaning look at every embedded row, however old it is."""

import datetime

import pytest

from daybook.operators import search
from daybook.operators.tools import Tools
from daybook.plans import catalogue

AT = datetime.datetime(2024, 1, 15)
SHAPE = "id long, timestamp timestamp_ntz, date date, app_name string, category string, summary string, ocr_text string, status string, bookmarked boolean, embedding array<float>"


@pytest.fixture(scope="module")
def old_hit(spark):
    """The nearest row is older than 600 others."""
    rows = [(i, AT + datetime.timedelta(minutes=i), AT.date(), "app", "coding", "", f"screen {i}", "ok", False, [1.0, 0.0] if i == 0 else [0.6, 0.8]) for i in range(601)]
    return spark.createDataFrame(rows, SHAPE).repartition(2)


@pytest.fixture(scope="module")
def no_meetings(spark):
    return spark.createDataFrame([], "id long, start_time timestamp_ntz, app_name string, duration_minutes double, transcript string, summary string")


def test_agent_tool_search(old_hit):
    found = search.tool_search(old_hit, ["ocr_text", "app_name"], "nothing", [1.0, 0.0], 3).collect()
    assert [(r["id"], r["relevance"], r["match"]) for r in found] == [(0, 1.0, "semantic"), (599, 0.6, "semantic"), (600, 0.6, "semantic")]
    assert "limit 500" not in catalogue.ORACLES["agent_tool_search"]


def test_hybrid_search(old_hit, no_meetings):
    found = search.hybrid(old_hit, no_meetings, ["ocr_text", "app_name"], "nothing", [1.0, 0.0], 3).collect()
    assert [(r["id"], r["relevance"], r["match_type"]) for r in found] == [("0", 1.0, "semantic"), ("599", 0.6, "semantic"), ("600", 0.6, "semantic")]
    assert "limit 500" not in catalogue.ORACLES["hybrid_search"]


def test_tool_search(old_hit, no_meetings):
    told = Tools(old_hit, old_hit, no_meetings, embed=lambda _: [1.0, 0.0]).search_screen("nothing", 1).first()["json"]
    assert '"count":1' in told and '"id":0,' in told


def test_nearest_takes_all_rows_unless_told_how_many(old_hit):
    assert [r["id"] for r in search.nearest(old_hit, [1.0, 0.0], 1).collect()] == [0]
    assert [r["id"] for r in search.nearest(old_hit, [1.0, 0.0], 1, cap=500).collect()] == [600]


def test_screens_of_few_ids_are_those_of_all(spark):
    from daybook.sources.tables import activities

    sf = "/root/testdata/sf0.001"
    ids = [0, 7, 205, 999]
    want = activities(spark, sf, "url", "text", "embedding").where("id in (0, 7, 205, 999)")
    assert sorted(activities(spark, sf, "url", "text", "embedding", ids=ids).collect()) == sorted(want.collect()) and want.count() == 4
    assert activities(spark, sf, "text", ids=[]).count() == 0


def test_keyword_rows_may_come_without_what_is_joined_on(spark, old_hit, tmp_path):
    from daybook.operators import textindex

    columns, plain = ["ocr_text", "app_name"], old_hit.drop("ocr_text", "embedding")
    index = textindex.build(old_hit, columns, str(tmp_path))
    found = search.tool_search(old_hit.drop("ocr_text"), columns, "5", [1.0, 0.0], 3, index=index, known=plain)
    assert sorted(found.collect()) == sorted(search.tool_search(old_hit, columns, "5", [1.0, 0.0], 3).collect())
    told = Tools(old_hit, old_hit, old_hit, embed=lambda _: [1.0, 0.0]).search_screen("5", 2).first()
    assert Tools(old_hit, old_hit, old_hit, embed=lambda _: [1.0, 0.0], screens=lambda ids: old_hit.where(old_hit["id"].isin(ids))).search_screen("5", 2).first() == told
