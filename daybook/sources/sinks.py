"""Where journal tables and reports go: snapshots of tables, text files by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.sources.files import confined, write_files  # noqa: F401  confined is part of this module's surface


def append(df: DataFrame, path: str) -> None:
    """Append activities, partitioned by day, so a day's filter reads that day only."""
    df.write.mode("append").partitionBy("date").parquet(path)


def replace_days(df: DataFrame, path: str) -> None:
    """Overwrite the days that ``df`` holds and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def snapshot(df: DataFrame, folder: str, name: str) -> str:
    """Write a whole table under a new name; the caller points readers to it."""
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_notes(summaries: DataFrame, folder: str) -> None:
    """Daily notes (date, summary, standup, total_activities) as ``{YYYY-MM-DD}.md`` in a vault's folder, one per day."""
    from daybook.operators.context import markdown

    title = F.date_format("date", "yyyy-MM-dd")
    text = markdown(title, F.col("summary"), F.col("standup"), F.col("total_activities"))
    write_files(summaries.select(F.concat(title, F.lit(".md")).alias("name"), text.alias("text"), "total_activities"), folder, order=["total_activities"])


def agent_outputs(outputs: DataFrame) -> DataFrame:
    """``(name, text, at)``: the file ``{slug}/{YYYY-MM-DD_HH-MM}.md`` of every
    agent output (slug, at, text), which opens with the agent's name and time."""
    stamp = F.date_format("at", "yyyy-MM-dd_HH-mm")
    text = F.concat(F.lit("# "), "slug", F.lit(" \u2014 "), stamp, F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return outputs.select(F.concat("slug", F.lit("/"), stamp, F.lit(".md")).alias("name"), text.alias("text"), "at")


def write_agent_outputs(outputs: DataFrame, folder: str) -> None:
    """Agent outputs as files; of an agent's outputs of one minute the latest stays."""
    write_files(agent_outputs(outputs), folder, order=["at"])


def output_path(folder: str, slug: str, at: str) -> str:
    """``{folder}/{slug}/{YYYY-MM-DD_HH-MM}.md`` for a time ``YYYY-MM-DD HH:MM``."""
    return f"{folder.rstrip('/')}/{slug}/{at.replace(' ', '_').replace(':', '-')}.md"


def to_json(df: DataFrame) -> DataFrame:
    """Rows as JSON texts, as an interface would send them."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
