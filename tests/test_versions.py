"""Stored tables with versions: changes on disk against the same changes in memory."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from daybook.operators import maintain
from daybook.sources.versions import Conflict, Table

DAY = datetime.datetime(2024, 1, 1, 12)
SCHEMA = "id long, timestamp timestamp_ntz, summary string, bookmarked boolean"


def rows(spark, n=20, start=0):
    return spark.createDataFrame([(i, DAY + datetime.timedelta(days=i % 4), f"s{i}", i % 3 == 0) for i in range(start, start + n)], SCHEMA)


def held(df):
    return sorted(map(tuple, df.select("id", "timestamp", "summary", "bookmarked").collect()))


def folders(table, kind):
    """Which days each write of a kind has files of."""
    base = f"{table.folder}/{kind}"
    return {v: sorted(d for d in os.listdir(f"{base}/{v}") if d.startswith("_day=")) for v in (os.listdir(base) if os.path.isdir(base) else []) if v.startswith("ver=")}


@pytest.fixture
def table(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.append(rows(spark))
    return t


def test_append_and_days(spark, table):
    assert table.append(rows(spark, 4, 100)) == 2
    assert held(table.read()) == held(rows(spark).unionByName(rows(spark, 4, 100)))
    day = table.read("2024-01-02", "2024-01-02")
    assert {r["id"] % 4 for r in day.collect()} == {1} and day.count() == 6
    files = day.inputFiles()
    assert files and all("_day=2024-01-02" in f for f in files)
    assert held(table.read(version=1)) == held(rows(spark))


def test_update_rewrites_nothing_but_the_changed_rows(spark, table):
    before = folders(table, "data")
    table.update(F.col("id").isin(1, 5), {"summary": F.lit("new")})
    want = maintain.merge_by(rows(spark), rows(spark).where("id in (1, 5)").withColumn("summary", F.lit("new")), "id", ["summary"])
    assert held(table.read()) == held(want)
    assert folders(table, "data") == before and list(folders(table, "deltas").values()) == [["_day=2024-01-02"]]
    clean = table.read("2024-01-01", "2024-01-01")
    assert "Join" not in clean._jdf.queryExecution().executedPlan().toString()  # that day has no deltas
    table.update(F.col("id") == 5, {"summary": F.lit("newer"), "bookmarked": F.lit(None).cast("boolean")})
    assert [r["summary"] for r in table.read().where("id = 5").collect()] == ["newer"]
    assert table.update(F.col("summary") == "nothing", {"summary": F.lit("x")}) == 3  # no version for no change


def test_a_row_changes_its_day(spark, table):
    table.update(F.col("id") == 4, {"timestamp": F.lit("2024-01-03 01:00:00").cast("timestamp_ntz")})
    assert [r["id"] for r in table.read("2024-01-01", "2024-01-01").orderBy("id").collect()] == [0, 8, 12, 16]
    assert 4 in {r["id"] for r in table.read("2024-01-03", "2024-01-03").collect()} and table.read().count() == 20


def test_upsert(spark, table):
    new = spark.createDataFrame([(2, DAY + datetime.timedelta(days=2), "", True), (3, DAY + datetime.timedelta(days=3), "over", None), (50, DAY, None, False), (None, DAY, "x", False)], SCHEMA)
    table.upsert(new, texts=["summary"])
    want = maintain.upsert(rows(spark), new.where("id is not null"), "id", ["summary"])
    assert held(table.read()) == sorted(held(want), key=str) or held(table.read()) == held(want)


def test_toggle_reports_absent_ids(spark, table):
    number, absent = table.toggle([0, 1, 77, 78])
    assert (number, absent) == (2, [77, 78])
    assert held(table.read()) == held(maintain.toggle(rows(spark), [0, 1]))
    assert table.toggle([77]) == (2, [77])


def test_delete_cascade_and_retention(spark, table, tmp_path):
    children = Table(spark, str(tmp_path / "c"), day="cast(at as date)")
    children.append(spark.createDataFrame([(i, i, DAY) for i in range(20)] + [(90, None, DAY), (91, 500, DAY)], "id long, activity_id long, at timestamp_ntz"))
    table.delete(F.col("id") < 3)
    children.cascade(table.read())
    assert {r["id"] for r in children.read().collect()} == {*range(3, 20), 90}
    before = folders(table, "data"), folders(table, "deltas")
    table.retain("2024-01-05", 2)  # days before the 3rd go
    assert {str(r["timestamp"].date()) for r in table.read().collect()} == {"2024-01-03", "2024-01-04"}
    assert (folders(table, "data"), folders(table, "deltas")) == before and table.retain("2024-01-05", 0) == 3
    assert held(table.read(version=2)) == held(rows(spark).where("id >= 3"))


def test_compaction_touches_changed_days_only(spark, table):
    table.update(F.col("id") == 1, {"summary": F.lit("a")})
    table.delete(F.col("id") == 5)
    want = held(table.read())
    first = set(folders(table, "data"))
    table.compact()
    assert held(table.read()) == want
    (new,) = set(folders(table, "data")) - first
    assert folders(table, "data")[new] == ["_day=2024-01-02"]
    assert "Join" not in table.read()._jdf.queryExecution().executedPlan().toString()
    assert table.vacuum(keep=1) == 2  # both deltas; the first write holds other days still
    assert held(table.read()) == want and table.versions() == [4]


def test_a_failed_write_leaves_the_old_version(spark, table):
    @F.udf("string")
    def fails(x):
        raise RuntimeError("broken")

    want = held(table.read())
    with pytest.raises(Exception):
        table.update(F.col("id") > 0, {"summary": fails("summary")})
    assert table.versions() == [1] and held(table.read()) == want


def test_two_writers(spark, table):
    before = table.version()
    table.update(F.col("id") == 1, {"summary": F.lit("first")})
    with pytest.raises(Conflict):
        table._commit(before, {}, before["schema"], "late")
    assert [r["summary"] for r in table.read().where("id = 1").collect()] == ["first"]
    assert not [f for f in os.listdir(f"{table.folder}/versions") if f.startswith(".") and not f.endswith(".crc")]


def test_null_days_new_columns_and_empty_tables(spark, table):
    table.append(spark.createDataFrame([(200, None, "x", True, 5)], SCHEMA + ", more int"))
    assert [r["more"] for r in table.read().where("id in (1, 200)").orderBy("id").collect()] == [None, 5]
    table.update(F.col("id") == 200, {"summary": F.lit("y")})
    assert [r["summary"] for r in table.read().where("id = 200").collect()] == ["y"]
    empty = Table(spark, f"{table.folder}-empty")
    with pytest.raises(ValueError):
        empty.read()
    empty.append(rows(spark, 0))
    assert empty.read().count() == 0
