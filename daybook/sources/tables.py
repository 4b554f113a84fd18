"""Canonical journal tables over the event, document, page, vector and conversation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators.textindex import cell


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activities(spark: SparkSession, sf_dir: str, *extra: str, ids: list[int] | None = None) -> DataFrame:
    """One row per event. ``extra`` names what is joined on: url, text, embedding, or
    cell, what a text index holds of the text (``textindex.cell``); a query that needs none of them reads the event table alone.
    With a short list of ``ids`` only their rows are given, and only what belongs to them is joined on."""
    e = read(spark, sf_dir, "events")
    if ids is not None:
        e = e.where(F.col("event_id").isin(ids))
    kind = F.col("event_type")
    out = e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.col("ts").cast("date").alias("date"),
        F.when(kind == "click", "browsing").when(kind == "view", "media").when(kind == "purchase", "coding").when(kind == "signup", "writing").otherwise("terminal").alias("category"),
        F.when(F.col("event_id") % 97 == 0, "Voice Memo").otherwise(F.concat(F.lit("app_"), (F.col("user_id") % 12).cast("string"))).alias("app_name"),
        F.when(F.col("event_id") % 20 == 0, "skipped").when(F.col("event_id") % 20 == 1, "failed").when(F.col("event_id") % 20 == 2, "pending").when(F.col("event_id") % 20 == 3, "dead").otherwise("ok").alias("status"),
        (F.col("event_id") % 17 == 0).alias("bookmarked"),
        F.when(F.col("event_id") % 11 == 0, None).when(F.col("user_id") % 5 == 0, "productive").when(F.col("user_id") % 5 == 1, "distracted").when(F.col("user_id") % 5 == 2, "collaborative").when(F.col("user_id") % 5 == 3, "learning").otherwise("neutral").alias("mood"),
        "user_id",
        "value",
        "event_type",
    )

    def beside(name: str, key: str, column: str | Column, alias: str) -> DataFrame:
        side = read(spark, sf_dir, name)
        count = side.count()  # from the files' footers
        if ids is not None:
            side = side.where(F.col(key).isin([abs(i) % max(count, 1) * (1 if i >= 0 else -1) for i in ids]))  # the sign is that of the id, as in SQL
        return out.join(side.select(F.col(key).alias("_k"), (F.col(column) if isinstance(column, str) else column).alias(alias)), F.col("id") % F.lit(max(count, 1)) == F.col("_k"), "left").drop("_k")

    if "url" in extra:
        out = beside("pages", "page_id", "url", "page_url")
        out = out.withColumn("active_url", F.when(F.col("event_type") == "click", F.col("page_url"))).drop("page_url")
    if "text" in extra:
        out = beside("documents", "doc_id", "text", "ocr_text")
        out = out.withColumn("summary", F.substring("ocr_text", 1, 80))
    if "cell" in extra:
        out = beside("documents", "doc_id", cell(F.col("text")), "cell")
        out = out.withColumn("cell", F.coalesce("cell", cell(F.lit(""))))
    if "embedding" in extra:
        out = beside("embeddings", "vec_id", "embedding", "embedding")
    return out.drop("event_type")


def dev_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = activities(spark, sf_dir).where(F.col("category").isin("coding", "terminal"))
    return a.select("id", F.col("id").alias("activity_id"), F.concat(F.lit("repo_"), (F.col("user_id") % 8).cast("string")).alias("repo_name"), F.when(F.col("id") % 3 == 0, "main").otherwise("dev").alias("branch"), (F.col("id") % 50).cast("int").alias("insertions"), (F.col("id") % 20).cast("int").alias("deletions"))


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a meeting; its transcript has one line per turn."""
    lines = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(lines.alias("t"), (F.max("turn") + 1).cast("double").alias("duration_minutes"))
    start = F.make_timestamp_ntz(F.lit(2024), F.lit(1), (F.col("conv_id") % 30 + 1).cast("int"), (F.col("conv_id") % 24).cast("int"), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    c = c.withColumn("start_time", start)
    return c.select(
        F.col("conv_id").alias("id"),
        "start_time",
        F.when(F.col("conv_id") % 9 != 0, F.col("start_time") + F.make_dt_interval(mins=F.col("duration_minutes").cast("int"))).alias("end_time"),
        F.concat(F.lit("meet_"), (F.col("conv_id") % 3).cast("string")).alias("app_name"),
        "duration_minutes",
        F.array_join(F.transform("t", lambda x: F.concat(F.lit("["), x["role"], F.lit("] "), x["text"])), "\n").alias("transcript"),
        F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("notes of "), F.col("conv_id").cast("string"))).alias("summary"),
    )


#: The same tables for DuckDB, as common table expressions.
_A = """activities as (
 select e.event_id as id, e.ts as timestamp, e.ts::date as date,
  case e.event_type when 'click' then 'browsing' when 'view' then 'media' when 'purchase' then 'coding' when 'signup' then 'writing' else 'terminal' end as category,
  case when e.event_id % 97 = 0 then 'Voice Memo' else concat('app_', e.user_id % 12) end as app_name,
  case e.event_id % 20 when 0 then 'skipped' when 1 then 'failed' when 2 then 'pending' when 3 then 'dead' else 'ok' end as status,
  e.event_id % 17 = 0 as bookmarked,
  case when e.event_id % 11 = 0 then null else case e.user_id % 5 when 0 then 'productive' when 1 then 'distracted' when 2 then 'collaborative' when 3 then 'learning' else 'neutral' end end as mood,
  e.user_id, e.value, case when e.event_type = 'click' then p.url end as active_url, d.text as ocr_text, substr(d.text, 1, 80) as summary, v.embedding
 from events e left join documents d on d.doc_id = e.event_id % (select count(*) from documents)
  left join pages p on p.page_id = e.event_id % (select count(*) from pages)
  left join embeddings v on v.vec_id = e.event_id % (select count(*) from embeddings))"""
_D = """dev_contexts as (
 select id, id as activity_id, concat('repo_', user_id % 8) as repo_name, case when id % 3 = 0 then 'main' else 'dev' end as branch, (id % 50)::int as insertions, (id % 20)::int as deletions
 from activities where category in ('coding', 'terminal'))"""
_M = """meetings as (
 select *, case when id % 9 <> 0 then start_time + to_minutes(duration_minutes::int) end as end_time from (
 select conv_id as id, make_timestamp(2024, 1, (conv_id % 30 + 1), conv_id % 24, 0, 0.0) as start_time, concat('meet_', conv_id % 3) as app_name,
  (max(turn) + 1)::double as duration_minutes, string_agg(concat('[', role, '] ', text), chr(10) order by turn, role, text) as transcript,
  case when conv_id % 4 = 0 then concat('notes of ', conv_id) end as summary from conversations group by conv_id))"""


def with_tables(sql: str) -> str:
    """``sql`` over the canonical tables, for DuckDB. A statement of its own
    common table expressions starts with a comma-free ``with``."""
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {_A}, {_D}, {_M}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {_A}, {_D}, {_M}, {body[5:]}"
    return f"with {_A}, {_D}, {_M} {body}"
