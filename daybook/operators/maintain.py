"""Changes to journal tables. Each function returns the changed table; a
snapshot is written by the caller, never in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.operators.timeline import ascii_lower


def merge_by(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``old`` with the given columns of the matching ``new`` row, nulls included."""
    side = new.select(F.col(key).alias("_k"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = old.join(side, F.col(key) == F.col("_k"), "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def toggle(df: DataFrame, ids: list[int], column: str = "bookmarked") -> DataFrame:
    return df.withColumn(column, F.when(F.col("id").isin(*ids), ~F.col(column)).otherwise(F.col(column)))


def upsert(old: DataFrame, new: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """Insert or update by key. An empty or missing text keeps the old one; other columns are overwritten."""
    a, b = old.alias("a"), new.alias("b")
    out = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    there = F.col(f"b.{key}").isNotNull()

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(f"b.{c}", f"a.{c}").alias(c)
        if c in texts:
            return F.coalesce(F.nullif(F.col(f"b.{c}"), F.lit("")), F.col(f"a.{c}")).alias(c)
        return F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)

    return out.select(*[value(c) for c in old.columns])


def delete(df: DataFrame, which: Column) -> DataFrame:
    """The rows that do not match; an unknown match is none."""
    return df.where(~F.coalesce(which, F.lit(False)))


def cascade(children: DataFrame, parents: DataFrame, key: str = "activity_id") -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col("id").alias(key)), key, "left_semi")


def retain(df: DataFrame, today: str, days: int, column: str = "date") -> DataFrame:
    """Rows not older than ``days`` before today; all of them if ``days`` is not positive."""
    return df if days <= 0 else df.where(F.col(column) >= F.date_sub(F.lit(today).cast("date"), days))


def _days(name: str) -> Column:
    """The day of a journal table's rows."""
    return F.col("start_time").cast("date") if name == "meetings" else F.col("date")


def delete_day(tables: dict[str, DataFrame], day: str) -> dict[str, DataFrame]:
    """Every table (activities, dev_contexts, meetings, daily_summaries) without a day's rows."""
    left = {n: delete(t, _days(n) == F.lit(day).cast("date")) for n, t in tables.items() if n != "dev_contexts"}
    return left | ({"dev_contexts": cascade(tables["dev_contexts"], left["activities"])} if "dev_contexts" in tables else {})


def retain_all(tables: dict[str, DataFrame], today: str, days: int) -> dict[str, DataFrame]:
    """Every table without rows older than ``days``; contexts go with their activities."""
    if days <= 0:
        return dict(tables)
    left = {n: t.where(_days(n) >= F.date_sub(F.lit(today).cast("date"), days)) for n, t in tables.items() if n != "dev_contexts"}
    return left | ({"dev_contexts": cascade(tables["dev_contexts"], left["activities"])} if "dev_contexts" in tables else {})


def _starts(column: str, prefix: str) -> Column:
    return F.startswith(ascii_lower(F.col(column)), F.lit(prefix.lower()))


def backfill_status(df: DataFrame) -> DataFrame:
    """Derive the status of rows still pending from what their analysis left behind."""
    done = F.coalesce(F.col("analyzed"), F.lit(False))
    found = F.when(done & (_starts("summary", "Skipped (corrupt") | _starts("summary", "Skipped (screenshot deleted")), "dead").when(done & F.col("confidence").isNull(), "dead").when(done & (F.col("summary") == "Skipped (analysis backlog)"), "skipped").when(done & _starts("summary", "Analysis failed"), "failed").when(done, "ok").otherwise("pending")
    return df.withColumn("status", F.when(F.col("status") == "pending", found).otherwise(F.col("status")))


#: What an interrupted meeting is said to be.
UNEXPECTED = "(Session ended unexpectedly — no summary generated)"
INTERRUPTED = "⚠️ Session was interrupted. Click re-analyze (🔄) to generate summary."


def close_meetings(meetings: DataFrame) -> DataFrame:
    """End meetings left open where they began, with a note on what there is of them."""
    said = F.trim(F.coalesce("transcript", F.lit("")))
    note = F.when((said != "") & (said != "(No speech detected)"), INTERRUPTED).otherwise(UNEXPECTED)
    open_ = F.col("end_time").isNull()
    return meetings.withColumns({"summary": F.when(open_, note).otherwise(F.col("summary")), "duration_minutes": F.when(open_, 0.0).otherwise(F.col("duration_minutes")), "end_time": F.coalesce("end_time", "start_time")})


def mark_dead(activities: DataFrame, missing: DataFrame) -> DataFrame:
    """Rows whose image is missing or corrupt (column id) are given up."""
    return merge_by(activities, missing.select("id", F.lit("dead").alias("status")), "id", ["status"])


def set_state(state: Column, changes: dict[str, str | None]) -> Column:
    """A state map with keys set, or removed where the value is None."""
    gone = [k for k, v in changes.items() if v is None]
    put = F.create_map(*[F.lit(x) for k, v in changes.items() if v is not None for x in (k, v)]) if len(gone) < len(changes) else None
    kept = F.map_filter(state, lambda k, _: ~k.isin(*changes))
    return kept if put is None else F.map_concat(kept, put)


def set_enabled(text: Column, value: bool) -> Column:
    """Rewrite the first ``enabled:`` line of an agent file."""
    line = "(?ms)\\A(.*?^enabled:)[^\\n]*"
    return F.regexp_replace(text, line, f"$1 {str(value).lower()}")
