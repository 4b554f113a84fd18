"""Budgeted report texts, and routing of events to hooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators.stats import ok
from daybook.operators.timeline import newest_first


FEW_HOOKS = 10_000  # hooks that are broadcast


def _lines(activities: DataFrame, line: Column, label: str, rich: int, width: int, most: int) -> DataFrame:
    """``(date, place, entry)`` of a day's newest rows: ``line``, and for the first
    ``rich`` rows with organised text some of it behind ``label``."""
    day = Window.partitionBy("date").orderBy(*newest_first())
    text = F.trim(F.coalesce("organized_text", F.lit("")))
    rows = ok(activities).withColumn("place", F.row_number().over(day)).where(F.col("place") <= most)
    seen = F.count_if(text != "").over(day.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("shows", (text != "") & (seen <= rich))
    shown = F.concat(F.lit(f"\n  {label}: "), F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text))
    return rows.select("date", "place", F.concat(line, F.when(F.col("shows"), shown).otherwise("")).alias("entry"))


def entries(activities: DataFrame, *, rich: int = 20, width: int = 300, most: int = 150) -> DataFrame:
    """Lines of a day's report, newest first; the first ``rich`` rows with
    organised text show some of it. Columns: date, place, entry."""
    line = F.concat(F.lit("["), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), F.coalesce("app_name", F.lit("?")), F.lit(" ("), F.coalesce("category", F.lit("?")), F.lit("): "), F.coalesce("summary", F.lit("")))
    return _lines(activities, line, "Screen content", rich, width, most)


def standup_budget(window: int) -> int:
    """Characters that the activities of standup notes may take in a model's context window."""
    return (window - min(1024, window // 4) - 300) * 3 - 450


def standup(activities: DataFrame, window: int = 4096, *, rich: int = 15, width: int = 200, most: int = 150) -> DataFrame:
    """``(date, text)``: what standup notes of a day are written from, newest first, as far as the window goes."""
    line = F.concat(F.lit("- "), F.coalesce("app_name", F.lit("?")), F.lit(": "), F.coalesce("summary", F.lit("")))
    return report(within_budget(_lines(activities, line, "Content", rich, width, most), standup_budget(window)))


def within_budget(lines: DataFrame, budget: int) -> DataFrame:
    """The newest entries of each day whose lengths, one more each, fit the budget."""
    upto = F.sum(F.length("entry") + 1).over(Window.partitionBy("date").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return lines.withColumn("used", upto).where(F.col("used") <= budget)


def report(lines: DataFrame) -> DataFrame:
    """One text per day."""
    parts = F.array_sort(F.collect_list(F.struct("place", "entry")))
    return lines.groupBy("date").agg(F.array_join(F.transform(parts, lambda x: x["entry"]), "\n").alias("text"))


def agent_budget(window: int) -> int:
    """Characters an agent's data may take in a model's context window."""
    return min(max((window - 1800) * 4, 800), 12000)


def due(agents: DataFrame, now: str) -> DataFrame:
    """Enabled agents whose interval has passed since the last run; those that never ran are due."""
    waited = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_run").cast("timestamp"))
    return agents.where(F.col("enabled") & (F.coalesce(waited, F.lit(1 << 60)) >= F.col("seconds").cast("long") * 1_000_000))


def with_latest_run(agents: DataFrame, log: DataFrame) -> DataFrame:
    """Agents with the time and status of their latest run."""
    last = log.groupBy("agent").agg(F.max_by(F.struct("timestamp", "status"), F.struct("timestamp", "id")).alias("l"))
    return agents.join(last, agents["name"] == last["agent"], "left").select(agents["*"], F.col("l.timestamp").alias("last_run"), F.col("l.status").alias("last_status"))


def route(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """Events to the addresses that want them. ``hooks``: name, enabled, events
    and urls (comma-separated), secret; no events means all."""
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    few = lambda side: F.broadcast(side) if side.limit(FEW_HOOKS + 1).count() <= FEW_HOOKS else side
    h = hooks.where(F.coalesce("enabled", F.lit(True))).select("name", "secret", listed(F.col("events")).alias("wanted"), F.explode(listed(F.col("urls"))).alias("url"))
    some = h.where(F.size("wanted") > 0).withColumn("event", F.explode("wanted")).select("name", "secret", "url", "event").distinct()
    exact = events.join(few(some), "event")
    every = h.where(F.size("wanted") == 0).select("name", "secret", "url").withColumn("one", F.lit(1))
    rest = events.withColumn("one", F.lit(1)).join(few(every), "one").drop("one")
    return exact.select("id", "event", "name", "url").unionByName(rest.select("id", "event", "name", "url"))


def deliveries(routed: DataFrame, answers: DataFrame, *, attempts: int = 2) -> DataFrame:
    """What sending each routed event left behind: ``(id, name, url, event, attempt, status, status_code)``.
    ``answers`` (id, url, attempt, status_code) are those of the addresses; none is a failure. A further
    attempt is made only after a failed one, ``attempts`` at most."""
    tried = routed.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts)))).join(answers, ["id", "url", "attempt"], "left")
    good = F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    first = F.min(F.when(good, F.col("attempt"))).over(Window.partitionBy("id", "name", "url"))
    tried = tried.withColumn("fine", good).withColumn("first", first)
    sent = tried.where(F.col("first").isNull() | (F.col("attempt") <= F.col("first")))
    return sent.select("id", "name", F.substring("url", 1, 80).alias("url"), "event", "attempt", F.when(F.col("fine"), "ok").otherwise("failed").alias("status"), F.coalesce("status_code", F.lit(0)).alias("status_code"))


def payload(event: Column, timestamp: Column, data: Column, source: str = "daybook") -> Column:
    """The body sent to a hook."""
    return F.to_json(F.struct(event.alias("event"), timestamp.cast("string").alias("timestamp"), F.lit(source).alias("source"), data.alias("data")))


def markdown(title: Column, summary: Column, standup: Column, count: Column) -> Column:
    """A daily note."""
    return F.concat(F.lit("---\ntags: [journal]\ndate: "), title, F.lit("\nactivities: "), count.cast("string"), F.lit("\n---\n\n# "), title, F.lit("\n\n## Summary\n\n"), F.coalesce(summary, F.lit("")), F.when(F.coalesce(standup, F.lit("")) != "", F.concat(F.lit("\n\n## Standup\n\n"), standup)).otherwise(""))
