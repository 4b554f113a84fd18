"""Pages, filters and look-ups of the timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators.stats import in_range, ok

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def newest_first() -> list[Column]:
    return [F.col("timestamp").desc(), F.col("id").desc()]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, *_LOWER)


def contains(column: Column, text: str) -> Column:
    """Substring test that folds ASCII letters only; no sign of ``text`` is a wildcard."""
    return F.contains(ascii_lower(column), F.lit(text.translate(str.maketrans(*_LOWER))))


def with_context(activities: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every context of an activity is a row of its own; activities without one stay."""
    return activities.join(contexts.select(F.col("activity_id").alias("id"), "repo_name", "branch"), "id", "left")


def page(activities: DataFrame, contexts: DataFrame, date: str, limit: int = 100, offset: int = 0, since: str | None = None) -> DataFrame:
    """A page of a day, newest first. ``since`` filters the page, after the limit."""
    rows = with_context(in_range(activities, date, date), contexts).orderBy(*newest_first()).offset(offset).limit(limit)
    return rows.where(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss") > since) if since else rows


def rewind(activities: DataFrame, date: str) -> DataFrame:
    """A day in order of time, few columns."""
    return in_range(activities, date, date).select("id", "timestamp", "app_name", "category", "summary", "bookmarked", "status").orderBy("timestamp", "id")


def recent(activities: DataFrame, count: int = 10, most: int = 50) -> DataFrame:
    return ok(activities).orderBy(*newest_first()).limit(min(max(count, 1), most))


def last_minutes(activities: DataFrame, now: str, minutes: int = 30, limit: int = 50) -> DataFrame:
    """Of the newest rows of the day of ``now`` those not older than ``minutes``."""
    at = F.lit(now).cast("timestamp_ntz")
    return activities.where(F.col("date") == at.cast("date")).orderBy(*newest_first()).limit(limit).where(F.col("timestamp") >= at - F.make_dt_interval(mins=F.lit(minutes)))


def bookmarks(activities: DataFrame, limit: int = 50) -> DataFrame:
    return activities.where("bookmarked").orderBy(*newest_first()).limit(min(max(limit, 1), 200))


def by_hours(activities: DataFrame, date: str, first: int | None = None, last: int | None = None, limit: int | None = 100) -> DataFrame:
    """Analysed rows of a day between two hours, both inclusive and optional."""
    for h in (first, last):
        if h is not None and not 0 <= h <= 23:
            raise ValueError("hours are 0 to 23")
    rows = ok(in_range(activities, date, date))
    if first is not None:
        rows = rows.where(F.hour("timestamp") >= first)
    if last is not None:
        rows = rows.where(F.hour("timestamp") <= last)
    rows = rows.orderBy("timestamp", "id")
    return rows.limit(limit) if limit else rows


def select_where(activities: DataFrame, *, date: str | None = None, app: str | None = None, category: str | None = None, url_contains: str | None = None, has_url: bool = False, text_prefix: int | None = 500, limit: int = 100, offset: int = 0) -> DataFrame:
    """Conjunction of what is asked for, newest first."""
    rows = in_range(activities, date, date)
    if app:
        rows = rows.where(F.col("app_name") == app)
    if category:
        rows = rows.where(F.col("category") == category)
    if url_contains:
        rows = rows.where(contains(F.col("active_url"), url_contains))
    if has_url:
        rows = rows.where(F.col("active_url").isNotNull() & (F.col("active_url") != ""))
    if text_prefix and "ocr_text" in rows.columns:
        rows = rows.withColumn("ocr_text", F.substring("ocr_text", 1, text_prefix))
    return rows.orderBy(*newest_first()).offset(offset).limit(limit)


def unanalysed(activities: DataFrame, limit: int = 10) -> DataFrame:
    """Rows that no analysis has touched, oldest first: by the column ``analyzed`` where a table has it, else by status."""
    open_ = ~F.coalesce(F.col("analyzed"), F.lit(False)) if "analyzed" in activities.columns else F.col("status") == "pending"
    return activities.where(open_).orderBy("timestamp", "id").limit(limit)


def retryable(activities: DataFrame, today: str) -> DataFrame:
    """Rows of today that may be analysed again, newest first."""
    return in_range(activities, today, today).where(F.col("status").isin("pending", "skipped", "failed")).orderBy(*newest_first())


def memos(activities: DataFrame, date: str) -> DataFrame:
    """Voice memos of a day, whatever their status: by the detected application where a table has it, too."""
    memo = F.coalesce(F.col("app_name") == "Voice Memo", F.lit(False))
    if "detected_app" in activities.columns:
        memo = memo | F.coalesce(F.col("detected_app") == "Voice Memo", F.lit(False))
    return in_range(activities, date, date).where(memo).orderBy(*newest_first())


def relative_range(name: str, today: str) -> tuple[str | None, str | None]:
    """Bounds of today, 7d, 30d or all."""
    import datetime

    days = {"today": 0, "7d": 6, "30d": 29}
    if name not in days:
        return None, None
    return str(datetime.date.fromisoformat(today) - datetime.timedelta(days=days[name])), today


def any_of(column: Column, words: tuple[str, ...]) -> Column:
    """Whether the lower-cased text contains one of the words."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(column), w))


def blocked(column: Column, apps: tuple[str, ...]) -> Column:
    return F.lower(column).isin(*[a.lower() for a in apps])


def stale(activities: DataFrame, now: str, seconds: int = 180) -> DataFrame:
    """Rows older than ``seconds`` at ``now`` that no bookmark keeps."""
    return activities.where(~F.col("bookmarked") & (F.col("timestamp") < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(seconds))))


def latest_per(df: DataFrame, *keys: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(*newest_first())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def keep_newest(df: DataFrame, count: int, *keys: str) -> DataFrame:
    """The newest rows of each key; of the whole table without keys, by a sorted limit."""
    if not keys:
        return df.orderBy(*newest_first()).limit(count)
    w = Window.partitionBy(*keys).orderBy(*newest_first())
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= count).drop("_r")


def app_runs(activities: DataFrame, key: str = "user_id") -> DataFrame:
    """Runs of one app per key: its first and last time and its rows."""
    w = Window.partitionBy(key).orderBy("timestamp", "id")
    changed = F.coalesce((F.col("app_name") != F.lag("app_name").over(w)).cast("int"), F.lit(1))
    runs = activities.withColumn("c", changed).withColumn("run", F.sum("c").over(w))
    return runs.groupBy(key, "run").agg(F.first("app_name").alias("app_name"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"), F.count(F.lit(1)).alias("n"))


def quiet_sessions(activities: DataFrame, seconds: int = 60, key: str = "user_id") -> DataFrame:
    """Bursts separated by at least ``seconds`` of quiet; only each burst's last row is kept."""
    w = Window.partitionBy(key).orderBy("timestamp", "id")
    gap = F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(F.lag("timestamp").over(w).cast("timestamp"))
    marked = activities.withColumn("c", F.coalesce((gap >= seconds * 1_000_000).cast("int"), F.lit(1))).withColumn("burst", F.sum("c").over(w))
    return marked.groupBy(key, "burst").agg(F.max_by("id", F.struct("timestamp", "id")).alias("id"), F.count(F.lit(1)).alias("n"))
