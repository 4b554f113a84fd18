"""Delivering events to hooks from a stream, with a log and a second attempt.

``HookSink`` is the function of a ``foreachBatch``. Each micro-batch routes its
events (``context.route``), leaves out what the log holds already, adds the
failed attempts of earlier batches whose time has come, sends all of it from
the executors, and appends one log row per attempt. So a batch that Spark
replays, after a restart say, sends nothing that was logged; what a lost task
had sent without logging it is sent again under the same ``Idempotency-Key``,
which the receiver can tell by. Nothing waits: a failed attempt is due
``pause`` seconds later, in whatever batch (or ``drain``) comes then.

The log is one folder: a row has event id, hook, address, attempt, status, code,
error, time, and while another attempt is open the body it needs. An address
answers with a code; 200 to 299 is a success, no answer has code 0. Only the
log's keys are read to leave out what was sent.

Defined results: a null event has no hook. An event that repeats within a batch
is sent once. Addresses are logged up to 80 characters and errors up to 120;
keys use whole addresses.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators.context import payload, route

SHOWN_URL, SHOWN_ERROR = 80, 120
HOOK = "name string, enabled boolean, events string, urls string, secret string, headers string"
LOG = "id string, name string, url string, event string, attempt int, status string, status_code int, error string, sent_at double, body string"


def parse_headers(text: str | None) -> dict[str, str]:
    """``Key: Value`` lines; lines without a colon are left out."""
    pairs = (line.split(":", 1) for line in (text or "").split("\n") if ":" in line)
    return {k.strip(): v.strip() for k, v in pairs}


def post(url: str, body: bytes, headers: dict[str, str]) -> tuple[int, str]:
    """Send a body; the answer's code (0 without an answer) and what went wrong."""
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers, method="POST"), timeout=10) as answer:
            return answer.status, ""
    except urllib.error.HTTPError as e:
        return e.code, str(e)
    except Exception as e:  # noqa: BLE001  whatever it is, the attempt has failed
        return 0, str(getattr(e, "reason", e))


def request_headers(body: bytes, key: str, secret: str | None, own: str | None) -> dict[str, str]:
    signed = {"X-Signature": f"sha256={hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()}"} if secret else {}
    return {"Content-Type": "application/json", "Idempotency-Key": key} | signed | parse_headers(own)


@dataclass
class HookSink:
    """``hooks`` are rows of ``HOOK``; ``send`` takes (url, body, headers) and
    gives (code, error); ``clock`` gives the time in seconds."""

    spark: SparkSession
    hooks: list[tuple]
    folder: str
    send: Callable = post
    attempts: int = 2
    pause: float = 5.0
    parallel: int = 8
    clock: Callable[[], float] = field(default=lambda: __import__("time").time())

    def log(self) -> DataFrame:
        """Every attempt so far."""
        try:
            return self.spark.read.schema(LOG + ", batch string").parquet(f"{self.folder}/log")
        except AnalysisException:
            return self.spark.createDataFrame([], LOG + ", batch string")

    def recent(self, limit: int = 50) -> DataFrame:
        """The newest attempts, newest first, as a reader sees them."""
        shown = self.log().select("id", "name", F.substring("url", 1, SHOWN_URL).alias("url"), "event", "attempt", "status", "status_code", "error", "sent_at")
        return shown.orderBy(F.col("sent_at").desc(), F.col("id").desc(), "name", "url", F.col("attempt").desc()).limit(limit)

    def _table(self) -> DataFrame:
        return self.spark.createDataFrame(self.hooks, HOOK)

    def _first(self, events: DataFrame) -> DataFrame:
        """First attempts of events (id, event, timestamp, data)."""
        bodies = events.select(F.col("id").cast("string").alias("id"), payload(F.col("event"), F.col("timestamp"), F.col("data")).alias("body"))
        bodies = bodies.groupBy("id").agg(F.min("body").alias("body"))
        routed = route(events.select(F.col("id").cast("string").alias("id"), "event"), self._table()).distinct()
        return routed.join(bodies, "id").select("id", "name", "url", "event", F.lit(1).alias("attempt"), "body")

    def _due(self, now: float) -> DataFrame:
        """Failed attempts whose time has come and that have none after them."""
        log = self.log()
        latest = log.groupBy("id", "name", "url").agg(F.max_by(F.struct("event", "attempt", "status", "sent_at", "body"), "attempt").alias("l")).select("id", "name", "url", "l.*")
        late = latest.where((F.col("status") == "failed") & (F.col("attempt") < self.attempts) & (F.col("sent_at") + self.pause <= now))
        return late.select("id", "name", "url", "event", (F.col("attempt") + 1).alias("attempt"), "body")

    def _sent(self, attempts: DataFrame, batch: str, now: float) -> None:
        """Send attempts and append their log; the sending is the write's only pass over them."""
        logged = self.log().select("id", "name", "url", "attempt")
        secrets = {name: (secret, headers) for name, _, _, _, secret, headers in self.hooks}
        send, last = self.send, self.attempts

        def deliver(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for id_, name, url, event, attempt, body in frame.itertuples(index=False):
                    key = hashlib.sha256(f"{id_}\n{name}\n{url}\n{attempt}".encode()).hexdigest()
                    raw = body.encode()
                    code, error = send(url, raw, request_headers(raw, key, *secrets[name]))
                    good = 200 <= code < 300
                    out.append((id_, name, url, event, attempt, "ok" if good else "failed", code, "" if good else error[:SHOWN_ERROR], now, None if good or attempt >= last else body))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in LOG.split(", ")])

        open_ = attempts.join(logged, ["id", "name", "url", "attempt"], "left_anti").select("id", "name", "url", "event", "attempt", "body")
        open_.repartition(self.parallel, "url", "id").mapInPandas(deliver, LOG).write.mode("append").parquet(f"{self.folder}/log/batch={batch}")

    def __call__(self, events: DataFrame, batch_id: int) -> None:
        """What ``foreachBatch`` calls."""
        now = self.clock()
        self._sent(self._first(events).unionByName(self._due(now)), f"{batch_id:010d}", now)

    def drain(self) -> None:
        """Send what is due, without new events."""
        now = self.clock()
        self._sent(self._due(now), f"drain-{int(now * 1000):015d}", now)
