"""Folds against plain loops, streams against batch, maintenance and sources on small tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from daybook.operators import context, maintain
from daybook.sources import agents, sinks
from daybook.streaming import folds, streams

START = datetime.datetime(2024, 1, 1)


def frames(seed=1, n=300):
    rng = random.Random(seed)
    return [(rng.randint(0, 4), i, START + datetime.timedelta(seconds=rng.randint(0, 50_000)), rng.getrandbits(6), rng.choice(["YouTube", "Editor", "Slack"]), rng.choice(["coding", "media"])) for i in range(n)]


SCHEMA = "user_id long, id long, timestamp timestamp_ntz, h long, app_name string, category string"


def ordered(rows):
    return sorted(rows, key=lambda r: (r[2], r[1]))


def test_dedup_keeps_against_the_last_kept(spark):
    rows = frames()
    want = set()
    for user in range(5):
        last = None
        for r in ordered(r for r in rows if r[0] == user):
            if last is None or bin(last ^ r[3]).count("1") > 2:
                last = r[3]
                want.add((user, r[1]))
    got = folds.frame_dedup(spark.createDataFrame(rows, SCHEMA), threshold=2)
    assert {tuple(r) for r in got.collect()} == want


def test_dedup_kernel_resets():
    rows = [(1, 0, 0, "m", False, False), (2, 1, 1, "m", False, False), (3, 2, 0, "n", False, False), (4, 3, 0, "n", True, False), (5, 4, 0, "n", False, True), (6, 5, 0, "n", False, False)]
    kept, state = folds.dedup_kernel(None, rows)
    assert kept == [1, 3, 4, 6] and state == (0, "n")


def test_tiers():
    rows = [(1, 0, 0, False), (2, 10, 0b111, False), (3, 20, 0b11111, False), (4, 430, 0b1111111111, False), (5, 431, 0b1111111111, True), (6, 432, 0b1111111111, False)]
    assert folds.tier_kernel(None, rows)[0] == [(1, "full"), (2, "identical"), (3, "minor"), (4, "full"), (5, "full"), (6, "identical")]
    # a minor change keeps the entry's time, so staleness runs from the last full analysis
    assert folds.tier_kernel(None, [(1, 0, 0, False), (2, 200, 31, False), (3, 250, 0, False)], "Slack")[0][-1] == (3, "full")
    many = [(i, i, f"app{i}", "", 0, False) for i in range(31)] + [(99, 99, "app0", "", 0, False), (100, 100, "app5", "", 0, False)]
    out = dict(folds.tiers_with_eviction(many))
    assert out[99] == "full" and out[100] == "identical"


def test_alerts():
    minute = 60
    rows = [(1, 0, "YouTube", ""), (2, 44 * minute, "youtube", ""), (3, 46 * minute, "YouTube", ""), (4, 60 * minute, "YouTube", ""), (5, 91 * minute, "YouTube", "")]
    assert folds.alert_kernel(None, rows)[0] == [(3, "distraction", 46), (5, "distraction", 91), (5, "break", 91)]
    assert ("focus" in {k for _, k, _ in folds.alert_kernel(None, [(1, 0, "ide", "coding"), (2, 121 * minute, "ide", "coding")])[0]})
    first, state = folds.alert_kernel(None, rows[:3])
    second, _ = folds.alert_kernel(state, rows[3:])
    assert first + second == folds.alert_kernel(None, rows)[0]


def test_meetings_and_polls():
    probes = [(0, True, True, True), (10, True, True, True), (20, False, True, True), (30, True, True, True), (40, False, True, True), (50, False, True, True), (60, False, True, True), (100, True, True, True), (200, True, True, True)]
    assert folds.meeting_kernel(None, probes)[0] == [(0, 60)]
    gone = [(0, True, True, True), (5, True, True, True), (10, False, False, False), (45, False, False, False)]
    assert folds.meeting_kernel(None, gone)[0] == [(0, 45)]
    looks = folds.poll_kernel([(t, t == 45) for t in range(0, 90, 5)])
    assert looks == [(0, True), (10, False), (15, False), (20, False), (40, False), (45, True), (55, False), (60, False), (65, False), (85, False)]


def test_windowed_counts_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(frames(3), SCHEMA).write.parquet(source)
    rows = spark.read.parquet(source)
    q = streams.tumbling(streams.timed(spark.readStream.schema(rows.schema).parquet(source))).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination(120)
    want = streams.tumbling(rows.withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, want.collect()))


def test_backfill_golden(spark):
    rows = [("a", True, 0.85, "User is coding", "ok"), ("b", True, 0.3, "User browsing", "ok"), ("c", True, 0.0, "Skipped (analysis backlog)", "skipped"), ("d", True, 0.0, "Analysis failed: Connection refused", "failed"), ("e", True, None, "Skipped (corrupt screenshot)", "dead"), ("f", False, None, "Skipped (screenshot deleted)", "pending"), ("g", False, None, None, "pending"), ("h", True, None, "User was reading", "dead")]
    df = spark.createDataFrame([(*r[:4], "pending") for r in rows], "k string, analyzed boolean, confidence double, summary string, status string")
    once = maintain.backfill_status(df)
    assert {r.k: r.status for r in once.collect()} == {r[0]: r[4] for r in rows}
    again = maintain.backfill_status(once)
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))


def test_migration_and_state(spark):
    from daybook.schema import VERSION, migrate

    old = spark.createDataFrame([(1, "x")], "id bigint, app_name string")
    new = migrate(old, VERSION)
    assert new.first()["status"] == "pending" and migrate(new, VERSION).columns == new.columns
    assert "status" not in migrate(old, VERSION - 1).columns
    s = spark.createDataFrame([({"a": "1", "b": "2"},)], "s map<string,string>").select(maintain.set_state(F.col("s"), {"a": "3", "b": None, "c": "4"}).alias("s")).first()["s"]
    assert s == {"a": "3", "c": "4"}
    t = spark.createDataFrame([("---\nname: x\nenabled: true\n---\nenabled: no",)], "t string").select(maintain.set_enabled(F.col("t"), False).alias("t")).first()["t"]
    assert t == "---\nname: x\nenabled: false\n---\nenabled: no"


def test_agent_files(spark, tmp_path):
    (tmp_path / "report.md").write_text("---\nname: Daily\nschedule: every 2h\ndata: Apps, urls\nenabled: no\nmodel_requirement: 4096\n---\nWrite it.\n")
    (tmp_path / "plain.md").write_text("Just do it.")
    (tmp_path / "plug.py").write_text('"""\nname: Plug\ndescription: does: things\n"""\nrun = 1\n')
    (tmp_path / "_draft.md").write_text("x")
    out = {r.slug: r for r in agents.discover(spark, str(tmp_path)).collect()}
    assert out.keys() == {"plain", "plug", "report"}
    r = out["report"]
    assert (r.name, r.seconds, r.enabled, r.sections, r.model_requirement, r.prompt) == ("Daily", 7200, False, ["apps", "urls"], 4096, "Write it.")
    assert (out["plain"].name, out["plain"].seconds, out["plain"].sections, out["plain"].prompt) == ("plain", 21600, ["apps", "timeline"], "Just do it.")
    assert (out["plug"].type, out["plug"].name, out["plug"].description, out["plug"].seconds) == ("python", "Plug", "does: things", 3600)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "one\ntwo"), ("b", "three")], "name string, text string")
    sinks.write_files(df, str(tmp_path / "out"))
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a": "one\ntwo", "b": "three"}
    days = spark.createDataFrame([(1, datetime.date(2024, 1, 1)), (2, datetime.date(2024, 1, 2))], "id long, date date")
    sinks.append(days, str(tmp_path / "t"))
    sinks.replace_days(days.where("id = 2").withColumn("id", F.lit(5).cast("long")), str(tmp_path / "t"))
    assert {(r.id, str(r.date)) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "2024-01-01"), (5, "2024-01-02")}
    assert sinks.output_path("/d", "x", "2024-01-02 03:04") == "/d/x/2024-01-02_03-04.md"
    assert sinks.confined("/d", "a/../b") == "/d/b"
    with pytest.raises(ValueError):
        sinks.confined("/d", "../e")


def test_budget():
    assert [context.agent_budget(w) for w in (2000, 4096, 100_000)] == [800, 9184, 12000]
