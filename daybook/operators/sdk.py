"""The data functions that plug-ins call by name, each answered by a table.

``Journal.call("get_urls_visited", date="2024-01-15")`` and the method of that
name are the same. Dates default to the journal's today. Limits are those that
callers know; where a function looks at the newest 200 rows only, ``limit=None``
makes it look at all of a day.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.operators import stats, timeline
from daybook.sources.files import write_files


@dataclass
class Journal:
    """A journal's tables as of ``now`` (``YYYY-MM-DD HH:MM:SS``); ``find`` answers searches (query, limit); files are written below ``folder``."""

    activities: DataFrame
    meetings: DataFrame
    summaries: DataFrame
    now: str
    find: Callable[[str, int], DataFrame] | None = None
    folder: str | None = None
    settings: dict | None = None

    @property
    def today(self) -> str:
        return self.now[:10]

    def get_recent_activity(self, minutes: int = 30, limit: int = 50) -> DataFrame:
        """Rows of the last minutes, newest first."""
        return timeline.last_minutes(self.activities, self.now, minutes, limit)

    def get_activities_by_date(self, date_str: str, limit: int = 200) -> DataFrame:
        """A day's rows, newest first."""
        return timeline.select_where(self.activities, date=date_str, limit=limit)

    def get_activities(self, date: str | None = None, app: str | None = None, category: str | None = None, url_contains: str | None = None, limit: int = 50) -> DataFrame:
        """Rows of a day that fit all that is asked for, newest first."""
        return timeline.select_where(self.activities, date=date or self.today, app=app, category=category, url_contains=url_contains, limit=limit)

    def get_urls_visited(self, date: str | None = None, limit: int | None = 200) -> DataFrame:
        """``(url, app, timestamp, summary, count)`` of a day, most visited first, with what the newest visit was."""
        day = stats.in_range(self.activities, date or self.today, date or self.today)
        found = stats.url_visits(day, newest=limit)
        return found.select("url", F.col("app_name").alias("app"), F.col("last_visit").alias("timestamp"), "summary", F.col("visits").alias("count")).orderBy(F.col("count").desc(), "url")

    def get_meetings(self, date: str | None = None) -> DataFrame:
        """A day's meetings in order of their start."""
        return self.meetings.where(F.col("start_time").cast("date") == F.lit(date or self.today).cast("date")).orderBy("start_time", "id")

    def get_app_usage(self, date: str | None = None, limit: int | None = 200) -> DataFrame:
        """``(app_name, captures, categories)`` of a day's newest rows."""
        return stats.app_usage(stats.in_range(self.activities, date or self.today, date or self.today), newest=limit)

    def get_summary(self, date_str: str | None = None) -> DataFrame:
        """``(date, summary)`` of a day; an empty text where there is none."""
        asked = self.activities.sparkSession.range(1).select(F.lit(date_str or self.today).cast("date").alias("date"))
        return asked.join(self.summaries.select("date", "summary"), "date", "left").select("date", F.coalesce("summary", F.lit("")).alias("summary"))

    def get_stats(self) -> DataFrame:
        """Rows by status."""
        return stats.status_breakdown(self.activities)

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """Rows that tell of a query, the most relevant first."""
        if self.find is None:
            raise ValueError("this journal has no search")
        return self.find(query, limit)

    def write_file(self, path: str, content: str) -> None:
        """Write a file below the journal's folder; a path that leaves it is an error."""
        if self.folder is None:
            raise ValueError("this journal has no folder")
        spark = self.activities.sparkSession
        write_files(spark.createDataFrame([(path, content)], "name string, text string"), self.folder)

    def status(self) -> DataFrame:
        """The settings a reader may know, as one JSON text: the tools' status resource."""
        import json

        shown = {k: (self.settings or {}).get(k) for k in STATUS}
        return self.activities.sparkSession.createDataFrame([(json.dumps(shown, indent=2),)], "json string")

    def call(self, name: str, **given) -> DataFrame:
        """A function by its name; names that are none of the functions are an error."""
        if name not in FUNCTIONS:
            raise KeyError(f"no function {name}")
        return getattr(self, name)(**given)


FUNCTIONS = ("get_recent_activity", "get_activities_by_date", "get_activities", "get_urls_visited", "get_meetings", "get_app_usage", "get_summary", "get_stats", "search", "write_file", "status")
#: The settings that the status resource shows.
STATUS = ("model", "capture_interval", "performance_mode", "analysis_mode", "capture_active_monitor", "data_path")
