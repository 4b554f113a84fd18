"""Record shapes and fixed vocabularies of an activity journal."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values, in declared order; the order decides when several match.
CATEGORIES = ("coding", "browsing", "communication", "writing", "design", "media", "terminal", "meeting", "idle", "other")
MOODS = ("productive", "distracted", "collaborative", "learning", "neutral")
STATUSES = ("pending", "ok", "skipped", "failed", "dead")
PRODUCTIVE = ("coding", "writing", "terminal", "design", "meeting")
EVENTS = ("daily_summary", "bookmark", "agent_output", "test")

BOX = "struct<box:array<array<int>>,text:string,conf:double>"
REGION = "struct<name:string,x_start:double,x_end:double,y_start:double,y_end:double,content_type:string>"


#: Table shapes as DDL, for readers and casts.
ACTIVITIES = f"""id bigint, timestamp timestamp_ntz, screenshot_path string, window_title string, detected_app string,
    bookmarked boolean, app_name string, category string, summary string, details string, visible_text array<string>,
    mood string, confidence double, embedding array<float>, ocr_text string, ocr_boxes array<{BOX}>,
    scene_description string, organized_text string, analyzed boolean, analysis_error string, analysis_method string,
    active_url string, status string, created_at timestamp_ntz"""
DEV_CONTEXTS = "id bigint, activity_id bigint, repo_name string, branch string, last_commit string, changed_files array<string>, insertions int, deletions int"
DAILY_SUMMARIES = "id bigint, date date, summary string, standup string, total_activities int, category_breakdown map<string,int>, top_repos array<string>, productive_hours double, created_at timestamp_ntz"
MEETINGS = "id bigint, start_time timestamp_ntz, end_time timestamp_ntz, app_name string, duration_minutes double, transcript string, summary string, created_at timestamp_ntz"
DELIVERIES = "id bigint, timestamp timestamp_ntz, hook_name string, event string, url string, status string, status_code int, error string, attempt int"

#: Columns that a later schema version added, with their defaults.
ADDED = {"active_url": None, "status": "pending"}
VERSION = 7


def migrate(df, version: int):
    """``df`` with every column a journal of this version has; columns present
    already stay as they are, so a second run changes nothing."""
    from pyspark.sql import functions as F

    for field in T.StructType.fromDDL(ACTIVITIES).fields:
        if field.name not in df.columns and (version >= VERSION or field.name not in ADDED):
            df = df.withColumn(field.name, F.lit(ADDED.get(field.name)).cast(field.dataType))
    return df
