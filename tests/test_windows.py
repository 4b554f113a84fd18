"""Windows and deduplication under a watermark: on time, late and too late rows."""

import datetime
from collections import Counter

import pytest

from daybook.streaming import streams

START = datetime.datetime(2024, 1, 1, 10, tzinfo=datetime.timezone.utc)
SCHEMA = "id long, timestamp timestamp, app_name string, category string, status string"


def row(i, minute, app="a", category="c", status="ok"):
    return (i, START + datetime.timedelta(minutes=minute), app, category, status)


#: The delay is 10 minutes. After the first batch the watermark is at 10:50, after the second at 12:00;
#: what is too late is told by the watermark of the batch before.
BATCHES = [
    [row(1, 0), row(2, 10), row(3, 60)],
    [row(4, 55), row(5, 130), row(6, 52)],  # 10:55 and 10:52 are late, within the delay
    [row(11, 131)],
    [row(7, 50), row(8, 125)],  # 10:50 is too late, 12:05 is not
    [row(9, 400, "z")],
    [row(10, 500, "z")],
]


@pytest.fixture
def run(spark, tmp_path):
    def go(make):
        source, name = str(tmp_path / "in"), f"w_{tmp_path.name}"
        for rows in BATCHES:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = streams.timed(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), "10 minutes")
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
        q.awaitTermination(120)
        return spark.table(name).collect(), q

    return go


def test_tumbling(run, spark):
    got, query = run(lambda s: streams.tumbling(s, "1 hour"))
    counts = {(r["start"].hour, r["n"]) for r in got if r["category"] == "c"}
    # 10:00: ids 1, 2, 4, 6; 11:00: id 3; 12:00: ids 5, 8 and 11; id 7 is counted nowhere
    assert counts >= {(10, 4), (11, 1), (12, 3)}
    assert streams.late_rows(query) == 1
    table = streams.tumbling(spark.createDataFrame([r for b in BATCHES for r in b if r[0] != 7], SCHEMA), "1 hour")
    assert {tuple(r) for r in got} <= {tuple(r) for r in table.collect()}


def test_sliding(run, spark):
    got, query = run(lambda s: streams.tumbling(s, "1 hour", "30 minutes"))
    table = streams.tumbling(spark.createDataFrame([r for b in BATCHES for r in b if r[0] != 7], SCHEMA), "1 hour", "30 minutes")
    want = {tuple(r) for r in table.collect()}
    # id 7 is too late for both of its windows; those of the last row have not closed
    assert streams.late_rows(query) >= 1
    assert {tuple(r) for r in got if r["start"].hour < 16} == {x for x in want if x[0].hour < 16}


def test_sessions(run):
    got, _ = run(lambda s: streams.sessions(s, "20 minutes"))
    found = sorted((r["app_name"], r["start"].strftime("%H:%M"), r["end"].strftime("%H:%M"), r["n"]) for r in got if r["app_name"] == "a")
    # ids 1 and 2; then 6, 4, 3; then 8, 5 and 11
    assert found == [("a", "10:00", "10:30", 2), ("a", "10:52", "11:20", 3), ("a", "12:05", "12:31", 3)]


def test_deduplication_within_the_watermark(spark, tmp_path):
    batches = [[row(1, 0, "x"), row(2, 1, "x"), row(3, 2, "y")], [row(4, 5, "x"), row(5, 60, "q")], [row(9, 61, "r")], [row(6, 70, "x"), row(7, 10, "y")], [row(8, 300, "q")]]
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = streams.timed(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), "10 minutes")
    q = streams.deduplicated(stream, ["app_name"]).writeStream.format("memory").queryName("dedup_rows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination(120)
    # id 4 repeats x in time; when id 6 comes x has been forgotten; id 7 is too late
    apps = Counter(r["app_name"] for r in spark.table("dedup_rows").collect())
    assert apps == {"x": 2, "y": 1, "q": 1, "r": 1} and streams.late_rows(q) == 1
    table = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    assert {(r["app_name"], r["id"]) for r in streams.deduplicated(table, ["app_name"]).collect()} == {("x", 1), ("y", 3), ("q", 5), ("r", 9)}


def test_counters_of_a_query(spark):
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([row(1, 0), row(2, 0, status="skipped"), row(3, 0, status="failed"), row(4, 0, status="failed")], SCHEMA)
    seen = Observation("capture")
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).collect()
    assert seen.get == {"rows": 4}
    assert streams.counted(rows).count() == 4
