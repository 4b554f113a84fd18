"""Hook deliveries from a stream: routes, attempts, replays, and the wire."""

import http.server
import json
import os
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from daybook.operators import context
from daybook.streaming import hooks

HOOKS = [("all", True, "", "http://a/x, http://b/y", "s", "X-Own: 1\nbroken"), ("marks", True, "bookmark", "http://c/z", "", ""), ("off", False, "", "http://d", "", None)]
EVENTS = "id long, event string, timestamp timestamp_ntz, data string"


def sender(folder):
    """A stand-in for the wire: notes every send in a file and answers by rule."""

    def send(url, body, headers):
        note = {"url": url, "id": json.loads(body)["data"], "key": headers["Idempotency-Key"], "signed": headers.get("X-Signature"), "own": headers.get("X-Own")}
        tries = sum(json.load(open(os.path.join(folder, f)))["id"] == note["id"] and json.load(open(os.path.join(folder, f)))["url"] == url for f in os.listdir(folder))
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            json.dump(note, f)
        i = int(note["id"])
        return (500, "e" * 200) if i % 3 == 0 and (tries == 0 or i % 6 == 0) else (0, "no answer") if i % 5 == 4 and tries == 0 else (200, "")

    return send


def sent(folder):
    return [json.load(open(os.path.join(folder, f))) for f in os.listdir(folder)]


def code(i, attempt):
    if i % 3 == 0 and (attempt == 1 or i % 6 == 0):
        return 500
    return 0 if i % 5 == 4 and attempt == 1 else 200


@pytest.fixture
def sink(spark, tmp_path):
    os.makedirs(tmp_path / "wire")
    made = hooks.HookSink(spark, HOOKS, str(tmp_path / "hooks"), sender(str(tmp_path / "wire")), parallel=2)
    made.now = 1000.0
    made.clock = lambda: made.now
    return made


def events(spark, ids):
    rows = [(i, ("bookmark", "daily_summary")[i % 2], None, str(i)) for i in ids]
    return spark.createDataFrame(rows, EVENTS).withColumn("timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def test_stream_replay_and_second_attempts(spark, tmp_path, sink):
    wire, source = str(tmp_path / "wire"), str(tmp_path / "in")
    events(spark, range(6)).coalesce(1).write.parquet(source)

    def run(state):
        stream = spark.readStream.schema(EVENTS).parquet(source)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start().awaitTermination(120)

    run("state")
    n = len(sent(wire))
    assert n == 6 * 2 + 3  # two addresses for all, one more for bookmarks
    run("other-state")  # the same batch once more, as after a lost checkpoint
    assert len(sent(wire)) == n and sink.log().count() == n
    sink.now += 4.9
    sink.drain()
    assert len(sent(wire)) == n  # not due yet
    sink.now += 0.2
    events(spark, [10, 10]).write.mode("append").parquet(source)
    run("state")  # a new event, sent once though it repeats, and the second attempts
    failed = [(i, u) for i in range(6) if code(i, 1) != 200 for u in ("a", "b", *("c" * (i % 2 == 0)))]
    assert len(sent(wire)) == n + len(failed) + 3
    sink.now += 100
    sink.drain()
    assert len(sent(wire)) == n + len(failed) + 3  # two attempts are all
    assert len({x["key"] for x in sent(wire)}) == len(sent(wire))
    assert all((x["signed"] is not None) == (x["url"] != "http://c/z") and x["own"] == (None if x["url"] == "http://c/z" else "1") for x in sent(wire))

    every = events(spark, [*range(6), 10])
    routed = context.route(every.select("id", "event"), spark.createDataFrame([h[:5] for h in HOOKS], "name string, enabled boolean, events string, urls string, secret string"))
    answers = spark.createDataFrame([(i, u, a, code(i, a)) for i in (*range(6), 10) for u in ("http://a/x", "http://b/y", "http://c/z") for a in (1, 2)], "id long, url string, attempt int, status_code int")
    want = context.deliveries(routed, answers).withColumn("id", F.col("id").cast("string"))
    columns = ["id", "name", "url", "event", "attempt", "status", "status_code"]
    assert sorted(map(tuple, sink.log().select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    log = sink.recent(5).collect()
    assert len(log) == 5 and log[0]["sent_at"] == 1005.1 and all(len(r["error"]) <= 120 for r in sink.log().collect())


def test_empty_batches(spark, sink):
    sink(events(spark, []), 0)
    sink.drain()
    assert sink.log().count() == 0 and sink.recent().count() == 0


def test_the_wire():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.rfile.read(int(self.headers["Content-Length"])), dict(self.headers)))
            self.send_response(404 if self.path == "/no" else 204)
            self.end_headers()

        def log_message(self, *args):
            pass

    seen = []
    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    headers = hooks.request_headers(b"{}", "k", "secret", "A: b: c\nnothing\n")
    assert hooks.post(f"{base}/yes", b"{}", headers) == (204, "")
    assert hooks.post(f"{base}/no", b"{}", {})[0] == 404
    server.shutdown()
    server.server_close()
    assert hooks.post(f"{base}/gone", b"{}", {})[0] == 0
    path, body, got = seen[0]
    assert (path, body, got["A"]) == ("/yes", b"{}", "b: c")
    import hashlib
    import hmac

    assert got["X-Signature"] == "sha256=" + hmac.new(b"secret", b"{}", hashlib.sha256).hexdigest()
