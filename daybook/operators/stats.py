"""Counts and roll-ups over activities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.schema import PRODUCTIVE


def in_range(df: DataFrame, first: str | None, last: str | None, column: str = "date") -> DataFrame:
    """Inclusive date bounds, either of which may be open."""
    if first:
        df = df.where(F.col(column) >= F.lit(first).cast("date"))
    if last:
        df = df.where(F.col(column) <= F.lit(last).cast("date"))
    return df


def ok(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "ok")


def count_by(df: DataFrame, *keys: str | Column, top: int | None = None) -> DataFrame:
    """Counts per key, the largest first, ties by key."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("n").desc(), *out.columns[:-1]]
    return out.orderBy(*order).limit(top) if top else out


def top_repos(contexts: DataFrame, activities: DataFrame, top: int = 10) -> DataFrame:
    """Whatever the status of the activity; contexts without a repository are left out."""
    some = contexts.where(F.col("repo_name").isNotNull() & (F.col("repo_name") != ""))
    return count_by(some.join(activities.select(F.col("id").alias("activity_id")), "activity_id"), "repo_name", top=top)


def status_breakdown(activities: DataFrame) -> DataFrame:
    """A missing status counts as pending."""
    return count_by(activities, F.coalesce("status", F.lit("pending")).alias("status"))


def meeting_totals(meetings: DataFrame) -> DataFrame:
    return meetings.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("duration_minutes"), F.lit(0.0)).alias("minutes"))


def combined(activities: DataFrame, contexts: DataFrame, meetings: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """All statistics of a date range as ``(metric, key, value)``."""
    a = in_range(activities, first, last)
    m = in_range(meetings.withColumn("date", F.col("start_time").cast("date")), first, last)
    good = ok(a)
    rows = lambda df, metric: df.select(F.lit(metric).alias("metric"), F.col(df.columns[0]).cast("string").alias("key"), F.col("n").cast("double").alias("value"))
    out = rows(good.agg(F.lit("").alias("k"), F.count(F.lit(1)).alias("n")), "total")
    out = out.unionByName(rows(count_by(good, "category"), "category"))
    out = out.unionByName(rows(count_by(good, "app_name", top=10), "app"))
    out = out.unionByName(rows(top_repos(contexts, a), "repo"))
    out = out.unionByName(rows(status_breakdown(a), "status"))
    totals = meeting_totals(m).select(F.explode(F.array(F.struct(F.lit("count").alias("k"), F.col("n").cast("double").alias("n")), F.struct(F.lit("minutes").alias("k"), F.col("minutes").alias("n")))).alias("x")).select("x.*")
    return out.unionByName(rows(totals, "meetings"))


def heatmap(activities: DataFrame) -> DataFrame:
    """Counts per weekday (0 is Sunday) and hour."""
    return ok(activities).groupBy((F.dayofweek("timestamp") - 1).alias("weekday"), F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def storage_estimate(activities: DataFrame, megabytes: float) -> DataFrame:
    """Growth by days kept, from the space used and the days with activities (at least one)."""
    days = activities.agg(F.count_distinct("date").alias("active_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n"))
    per_day = F.lit(megabytes) / F.greatest("active_days", F.lit(1))
    horizons = F.explode(F.array(*[F.lit(d) for d in (1, 7, 30, 90, 365)])).alias("days")
    return days.select("active_days", "first_date", "last_date", "n", per_day.alias("mb_per_day"), horizons).withColumn("mb", F.col("mb_per_day") * F.col("days")).drop("mb_per_day")


def disk_usage(files: DataFrame) -> DataFrame:
    """Files as Spark's binaryFile source lists them: their number and bytes."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def category_counter(activities: DataFrame) -> DataFrame:
    """A missing or empty category counts as other."""
    return count_by(ok(activities), F.coalesce(F.nullif("category", F.lit("")), F.lit("other")).alias("category"))


def repos_of_newest(activities: DataFrame, contexts: DataFrame, newest: int | None = 200, top: int = 5) -> DataFrame:
    """Per day the repositories of the newest rows, ties to the one seen last in time."""
    day = Window.partitionBy("date").orderBy(F.col("timestamp").desc(), F.col("id").desc())
    joined = activities.join(contexts.select(F.col("activity_id").alias("id"), "repo_name"), "id", "left")
    if newest:
        joined = joined.withColumn("r", F.row_number().over(day)).where(F.col("r") <= newest)
    counts = ok(joined).where("repo_name <> ''").groupBy("date", "repo_name").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("timestamp", "id")).alias("last"))
    best = Window.partitionBy("date").orderBy(F.col("n").desc(), F.col("last").desc())
    return counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top).select("date", "repo_name", "n", "place")


def productive_seconds(activities: DataFrame, interval: int = 40, *, newest: int | None = None) -> DataFrame:
    """Per day the capped time between productive rows: the first adds the
    interval, each later one its distance from the one before, twice the
    interval at most. ``newest`` looks at the newest rows of a day only."""
    if newest:
        recent = Window.partitionBy("date").orderBy(F.col("timestamp").desc(), F.col("id").desc())
        activities = activities.withColumn("r", F.row_number().over(recent)).where(F.col("r") <= newest)
    some = ok(activities).where(F.lower("category").isin(*PRODUCTIVE))
    before = F.lag("timestamp").over(Window.partitionBy("date").orderBy("timestamp", "id"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = micros(F.col("timestamp")) - micros(before)
    each = F.coalesce(F.least(gap, F.lit(2_000_000 * interval)), F.lit(1_000_000 * interval))
    return some.withColumn("g", each).groupBy("date").agg(F.sum("g").cast("bigint").alias("micros"))


def url_visits(activities: DataFrame, newest: int | None = 200) -> DataFrame:
    """Per URL its visits and the newest visit's app, time and, where a table has it, summary."""
    rows = activities.where(F.col("active_url").isNotNull() & (F.col("active_url") != ""))
    if newest:
        rows = rows.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(newest)
    more = ["summary"] if "summary" in activities.columns else []
    last = F.max_by(F.struct("app_name", "timestamp", *more), F.struct("timestamp", "id"))
    return rows.groupBy(F.col("active_url").alias("url")).agg(F.count(F.lit(1)).alias("visits"), last.alias("l")).select("url", "visits", F.col("l.app_name").alias("app_name"), F.col("l.timestamp").alias("last_visit"), *[F.col(f"l.{c}").alias(c) for c in more])


def app_usage(activities: DataFrame, newest: int | None = 200) -> DataFrame:
    """Per app its captures and sorted distinct categories."""
    rows = activities.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(newest) if newest else activities
    return rows.groupBy(F.coalesce("app_name", F.lit("Unknown")).alias("app_name")).agg(F.count(F.lit(1)).alias("captures"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


def facets(activities: DataFrame) -> DataFrame:
    """Counters a report shows: 8 apps, 5 categories, moods, 10 URLs, each with its place."""
    good = ok(activities)
    out = None
    for name, column, top in (("app", "app_name", 8), ("category", "category", 5), ("mood", "mood", None), ("url", "active_url", 10)):
        counts = good.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        if top:
            counts = counts.orderBy(F.col("n").desc(), "key").limit(top)
        part = counts.select(F.lit(name).alias("facet"), "key", "n")
        out = part if out is None else out.unionByName(part)
    return out


def summary_of(rows: DataFrame) -> DataFrame:
    """Distinct apps and categories, and the first and last time, of a result."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("app_name")), ",").alias("apps"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"))


def overview(activities: DataFrame, interval: int = 30) -> DataFrame:
    """Share analysed, the top category, apps used and hours tracked."""
    total = activities.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ok").alias("analysed"), F.count_distinct("app_name").alias("apps"))
    top = count_by(ok(activities), "category", top=1).select(F.col("category").alias("top_category"))
    return total.select("n", "analysed", "apps", (F.col("n") * interval).alias("seconds_tracked")).join(top, F.lit(True), "left")


def rms_and_peak(samples: Column) -> tuple[Column, Column]:
    """Root mean square and largest magnitude of an array of samples."""
    square = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return F.sqrt(square / F.greatest(F.size(samples), F.lit(1))), F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double")))), F.lit(0.0))
