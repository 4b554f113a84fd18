"""Watermarks, deduplication and windowed counts, the same over streams and tables.

Event times of a stream are TIMESTAMP; a journal's naive times are read as UTC.
A row that is late, but within the watermark's delay, is counted; one that
comes after its window has closed is dropped (``late_rows`` tells how many).
Folds with state of their own are in ``stateful``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def timed(df: DataFrame, delay: str = "3 minutes") -> DataFrame:
    """Naive times as UTC, with a watermark."""
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key. A stream forgets a key once the watermark has
    passed its row by the delay, so what it holds is bounded by the rows of that
    time; a table, which has no watermark, keeps the earliest row (ties by id)."""
    if df.isStreaming:
        return df.dropDuplicatesWithinWatermark(keys)
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("timestamp", "id"))).where("_at = 1").drop("_at")


def tumbling(df: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts per category and window."""
    w = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    return df.groupBy(w, "category").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "category", "n")


def sessions(df: DataFrame, gap: str = "300 seconds", key: str = "app_name") -> DataFrame:
    """Bursts of a key's rows with at most ``gap`` between them."""
    return df.groupBy(F.session_window("timestamp", gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def fresh(df: DataFrame, seconds: int = 180, now=None) -> DataFrame:
    """Rows not older than ``seconds`` when they are processed, and bookmarked ones."""
    now = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return df.where(F.col("bookmarked") | (F.col("timestamp").cast("timestamp") >= now - F.make_dt_interval(secs=F.lit(seconds))))


def counted(df: DataFrame, name: str = "capture") -> DataFrame:
    """Counters of a running query, seen by listeners as observed metrics."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"))


def late_rows(query) -> int:
    """How many rows the operators of a streaming query have dropped as too late, as far as its kept progress goes."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
