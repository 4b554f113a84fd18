"""Folds whose state ends: timers, late rows and forgotten keys, against batch and plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from daybook.streaming import stateful, streams
from daybook.streaming.stateful import ALERTS, DEDUP, LOOKS, MEETINGS, TIERS, Fold

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
ZERO = START.timestamp()


def streamed(spark, tmp_path, batches, schema, fold, key, delay="10 minutes"):
    """The fold's results over a stream that gets one list of rows a micro-batch."""
    source, name = str(tmp_path / "in"), f"out_{random.getrandbits(40)}"
    for k, rows in enumerate(batches):
        # files are read in order of their time
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = stateful.over_stream(streams.timed(stream, delay), fold, key)
    q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.awaitTermination(150)
        assert q.exception() is None
        state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    return sorted(map(tuple, spark.table(name).collect())), state


FRAMES = "user_id long, id long, timestamp timestamp, h long, monitor string, bookmarked boolean, paused boolean, app_name string, category string, changed boolean"


def frame(rng, i, second):
    return (rng.randint(0, 2), i, START + datetime.timedelta(seconds=second), rng.getrandbits(6), rng.choice("mn"), rng.random() < 0.1, rng.random() < 0.1, rng.choice(["YouTube", "Editor", "Slack"]), rng.choice(["coding", "media"]), rng.random() < 0.5)


def far(day):
    """A row of another key that moves the watermark on."""
    return (99, 10_000 + day, START + datetime.timedelta(days=day), 0, "m", False, False, "Editor", "media", False)


@pytest.mark.parametrize("fold", [DEDUP, ALERTS, LOOKS, TIERS], ids=["dedup", "alerts", "looks", "tiers"])
def test_late_rows_give_the_results_of_the_batch(spark, tmp_path, fold):
    rng = random.Random(5)
    rows = [frame(rng, i, 40 * i + rng.randint(0, 30)) for i in range(240)]
    key = ["app_name", "monitor"] if fold is TIERS else "user_id"
    shuffled = sorted(rows, key=lambda r: r[2].timestamp() + rng.randint(0, 500))  # up to 500 s out of order, the delay is 600
    batches = [shuffled[:120], shuffled[120:], [far(2)], [far(3)]]
    got, _ = streamed(spark, tmp_path, batches, FRAMES, fold, key)
    whole = spark.createDataFrame([r for b in batches[:3] for r in b], FRAMES)
    want = sorted(map(tuple, stateful.over_history(whole, fold, key).collect()))
    assert got and [r for r in got if r[0] != 99 and r[1] != 10_003] == [r for r in want if r[0] != 99]


PROBES = "room string, id long, timestamp timestamp, voice boolean, in_front boolean, alive boolean"


def probe(room, i, second, voice, in_front=True, alive=True):
    return (room, i, START + datetime.timedelta(seconds=second), voice, in_front, alive)


MEETING = [probe("a", 0, 0, True), probe("a", 1, 10, True), probe("a", 2, 100, True, False), probe("b", 3, 0, True), probe("b", 4, 15, True), probe("b", 5, 40, True)]


def test_a_meeting_closes_by_timer(spark, tmp_path):
    # room a was left at 100 s and no probe follows, b's probes stop at 40 s: both end 300 s later
    got, _ = streamed(spark, tmp_path, [MEETING, [probe("z", 90, 7200, False)], [probe("z", 91, 9000, False)]], PROBES, MEETINGS, "room")
    assert [(r[0], r[1] - ZERO, r[2] - ZERO) for r in got] == [("a", 0, 400), ("b", 0, 340)]
    whole = spark.createDataFrame(MEETING, PROBES)
    assert sorted(map(tuple, stateful.over_history(whole, MEETINGS, "room").collect())) == got
    assert stateful.over_history(whole, MEETINGS, "room", until=ZERO + 350).count() == 1  # a's has not ended by then


def test_state_of_a_gone_key_is_forgotten(spark, tmp_path):
    brief = Fold(DEDUP.kernel, DEDUP.columns, DEDUP.state, DEDUP.out, ttl=3600)
    same = lambda i, second, user=1: (user, i, START + datetime.timedelta(seconds=second), 7, "m", False, False, "Editor", "media", False)
    # the same picture within the hour is dropped, after it the last one is forgotten
    batches = [[same(1, 0)], [same(2, 1800)], [same(3, 5 * 3600)], [far(1)], [far(2)]]
    got, state = streamed(spark, tmp_path, batches, FRAMES, brief, "user_id")
    assert [r[1] for r in got if r[0] == 1] == [1, 3]
    assert max(state) > 0
    whole = spark.createDataFrame([r for b in batches[:3] for r in b], FRAMES)
    assert [r[1] for r in stateful.over_history(whole, brief, "user_id").orderBy("id").collect()] == [1, 3]
    # user 1's rows and state are gone in the end: what is left belongs to key 99
    assert state[-1] <= 4


def test_advance_in_plain_steps():
    minute = lambda m: m * 60.0
    rows = [(1, minute(0), "YouTube", ""), (2, minute(46), "YouTube", "")]
    whole, held = stateful.advance(ALERTS, None, rows, minute(50))
    first, part = stateful.advance(ALERTS, None, rows[:1], minute(10))
    second, part = stateful.advance(ALERTS, part, rows[1:], minute(50))
    assert whole == first + second == [(2, "distraction", 46)] and held == part
    assert stateful.advance(ALERTS, held, [], minute(46) + stateful.DAY) == ([], None)
    # a row at the moment of the deadline comes after it
    opened = stateful.advance(MEETINGS, None, [(0.0, True, True, True), (10.0, True, True, True)], 10.0)[1]
    assert stateful.advance(MEETINGS, opened, [(310.0, True, True, True)], 310.0)[0] == [(0.0, 310.0)]


def test_null_times_come_first_in_a_history(spark):
    rows = spark.createDataFrame([(1, 1, None, 7), (1, 2, START.replace(tzinfo=None), 7)], "user_id long, id long, timestamp timestamp_ntz, h long").select("*", F.lit("m").alias("monitor"), F.lit(False).alias("bookmarked"), F.lit(False).alias("paused"))
    assert [r["id"] for r in stateful.over_history(rows, DEDUP, "user_id").collect()] == [1]
