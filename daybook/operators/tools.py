"""The journal's tools for an agent: named questions with checked parameters, each answered by one JSON text."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.operators import search, stats, timeline
from daybook.operators.textindex import TextIndex
from daybook.sources.sinks import confined

MOST_RECENT, MOST_BY_TIME = 50, 100
SHOWN, SHOWN_BY_TIME = 500, 300  # characters of a screen's text in an answer


class BadParameter(ValueError):
    """A parameter that a tool does not take; its text is the answer's ``error``."""


def day(text: str) -> str:
    try:
        return datetime.date.fromisoformat(text).isoformat()
    except (TypeError, ValueError):
        raise BadParameter(f"'{text}' is no date of the form YYYY-MM-DD") from None


def between(name: str, value: int | None, low: int, high: int) -> int | None:
    if value is not None and not low <= value <= high:
        raise BadParameter(f"{name} must be {low} to {high}")
    return value


def answer(rows: DataFrame, name: str, order: list, **head) -> DataFrame:
    """One row: the JSON object of ``head``, the count and the rows in order. ``rows`` are few: every tool has a limit."""
    placed = rows.select(F.struct(*[F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)]).alias("at"), F.struct(*rows.columns).alias("row")]).alias("r"))
    listed = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"])
    told = placed.agg(listed.alias("rows"))
    return told.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in head.items()], F.size("rows").alias("count"), F.col("rows").alias(name))).alias("json"))


def _shown(rows: DataFrame, width: int, *more: str) -> DataFrame:
    return rows.select("id", "timestamp", F.col("app_name").alias("app"), "category", "summary", F.substring(F.coalesce("ocr_text", F.lit("")), 1, width).alias("text"), "bookmarked", *more)


@dataclass
class Tools:
    """Tools over a journal's tables. ``index`` is its text index, ``embed`` turns a question into a unit vector,
    ``screens`` gives the activities of a list of ids with their texts, where ``activities`` come without or at more cost."""

    activities: DataFrame
    contexts: DataFrame
    meetings: DataFrame
    index: TextIndex | None = None
    embed: object = None
    screens: object = None

    def search_screen(self, query: str, limit: int = 10) -> DataFrame:
        """Screens that tell of ``query``, by meaning and by words."""
        between("limit", limit, 1, 500)
        found = search.tool_search(self.activities, ["ocr_text", "app_name"], query, self.embed(query), limit, index=self.index)
        if self.screens is None:
            shown = self.activities
        else:
            held = found.collect()  # ``limit`` rows at most
            found = self.activities.sparkSession.createDataFrame(held, found.schema)
            shown = self.screens([r["id"] for r in held])
        rows = _shown(shown.join(F.broadcast(found), "id"), SHOWN, "relevance", "match")
        return answer(rows, "results", [-F.col("relevance"), F.col("match") != "semantic", F.col("id")], query=query)

    def recent_activity(self, count: int = 10) -> DataFrame:
        between("count", count, 1, 1 << 31)
        rows = timeline.recent(self.activities, min(count, MOST_RECENT))
        return answer(_shown(rows, SHOWN), "activities", [-F.unix_micros(F.col("timestamp").cast("timestamp")), -F.col("id")])

    def activity_by_time(self, date: str, start_hour: int | None = None, end_hour: int | None = None) -> DataFrame:
        between("start_hour", start_hour, 0, 23)
        between("end_hour", end_hour, 0, 23)
        rows = timeline.by_hours(self.activities, day(date), start_hour if start_hour is not None else 0, end_hour if end_hour is not None else 23, MOST_BY_TIME)
        return answer(_shown(rows, SHOWN_BY_TIME), "activities", [F.col("timestamp"), F.col("id")], date=date)

    def statistics(self, today: str) -> DataFrame:
        """Those of the last eight days."""
        last = datetime.date.fromisoformat(day(today))
        first = (last - datetime.timedelta(days=7)).isoformat()
        return answer(stats.combined(self.activities, self.contexts, self.meetings, first, today), "statistics", [F.col("metric"), F.col("key")], first=first, last=today)

    def search_audio(self, query: str, limit: int = 10) -> DataFrame:
        between("limit", limit, 1, 500)
        rows = search.meeting_hits(self.meetings, query, limit, around=100, otherwise=300)
        return answer(rows, "results", [-F.unix_micros(F.col("start_time").cast("timestamp")), -F.col("id")], query=query)

    def daily_summary(self, summaries: DataFrame, date: str) -> DataFrame:
        rows = summaries.where(F.col("date") == F.lit(day(date)).cast("date")).select("summary", "standup")
        return answer(rows, "summaries", [F.col("summary")], date=date)

    def screenshot(self, activity_id: int, folder: str) -> str:
        """The path of an activity's picture, below ``folder``."""
        found = self.activities.where(F.col("id") == activity_id).select("screenshot_path").first()
        if not found or not found[0]:
            raise BadParameter(f"no picture of activity {activity_id}")
        return confined(folder, found[0].removeprefix(folder))
