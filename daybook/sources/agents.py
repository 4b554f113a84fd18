"""Agent definition files and what agents leave behind, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.text import header_map, schedule_seconds, strip
from daybook.sources.files import read_files

_DEFAULTS = {"md": {"schedule": "every 6h", "data": "timeline, apps"}, "py": {"schedule": "every 1h", "data": ""}}


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, stem, kind, text)`` of agent files, but for those whose name starts with an underscore."""
    df = spark.read.text(folder, wholetext=True, recursiveFileLookup=False).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    name = F.substring_index("path", "/", -1)
    df = df.withColumn("kind", F.regexp_extract(name, r"\.(md|py)$", 1)).withColumn("stem", F.regexp_replace(name, r"\.(md|py)$", ""))
    return df.where((F.col("kind") != "") & ~F.startswith("stem", F.lit("_")))


def definition(text: Column, stem: Column, kind: Column) -> dict[str, Column]:
    """The columns that describe an agent: its head's settings with defaults, and its prompt."""
    head_md = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---\s*\n(.*)", 1)
    head_py = F.coalesce(F.nullif(F.regexp_extract(text, r'(?s)\A"""(.*?)"""', 1), F.lit("")), F.regexp_extract(text, r"(?s)\A'''(.*?)'''", 1))
    head = F.when(kind == "md", head_md).otherwise(head_py)
    pairs = header_map(head)
    lowered = F.map_from_entries(F.transform(F.map_entries(pairs), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v"))))
    get = lambda key, otherwise: F.coalesce(F.try_element_at(lowered, F.lit(key)), otherwise)
    body = F.when(head_md != "", strip(F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---\s*\n(.*)", 2))).otherwise(strip(text))
    schedule = get("schedule", F.when(kind == "md", _DEFAULTS["md"]["schedule"]).otherwise(_DEFAULTS["py"]["schedule"]))
    data = get("data", F.when(kind == "md", _DEFAULTS["md"]["data"]).otherwise(_DEFAULTS["py"]["data"]))
    return {
        "name": get("name", stem),
        "slug": stem,
        "type": F.when(kind == "md", "markdown").otherwise("python"),
        "schedule": schedule,
        "seconds": schedule_seconds(schedule),
        "description": get("description", F.lit("")),
        "enabled": F.lower(get("enabled", F.lit("true"))).isin("true", "yes", "1"),
        "output": get("output", F.lit("local")),
        "sections": F.array_sort(F.array_distinct(F.filter(F.transform(F.split(data, ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))),
        "model_requirement": F.coalesce(F.try_to_number(get("model_requirement", F.lit("0")), F.lit("9999999999")).cast("int"), F.lit(0)),
        "prompt": F.when(kind == "md", body),
    }


def discover(spark: SparkSession, folder: str) -> DataFrame:
    df = files(spark, folder)
    return df.select(*[c.alias(k) for k, c in definition(F.col("text"), F.col("stem"), F.col("kind")).items()], "path").orderBy("slug")


def outputs(spark: SparkSession, folder: str, newest: int = 20, width: int = 3000) -> DataFrame:
    """An agent's newest output files by name: their size, first characters, and how many files there are in all."""
    found = read_files(spark, folder, "*.md")
    total = found.agg(F.count(F.lit(1))).scalar().alias("total")
    return found.select(F.col("name").alias("file"), "size", F.substring("text", 1, width).alias("text"), total).orderBy(F.col("file").desc()).limit(newest)


def run_log(spark: SparkSession, path: str, newest: int = 30) -> DataFrame:
    """The latest runs, newest first, of a JSON log (one object a line)."""
    return spark.read.schema("id bigint, agent string, timestamp timestamp_ntz, status string, message string").json(path).orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(newest)


def _fits(value, rule) -> bool:
    """A rule is a type, or a type and a test."""
    kind, test = rule if isinstance(rule, tuple) else (rule, None)
    return isinstance(value, kind) and not (kind is int and isinstance(value, bool)) and (test is None or bool(test(value)))


def settings(path: str, allowed: dict) -> dict:
    """Allow-listed overrides of a JSON file; values that do not fit their rule are left out."""
    import json

    try:
        with open(path) as f:
            found = json.load(f)
    except (OSError, ValueError):
        return {}
    return {k: v for k, v in found.items() if k in allowed and _fits(v, allowed[k])} if isinstance(found, dict) else {}


def save_settings(path: str, changes: dict, allowed: dict) -> dict:
    """Put the changes that fit into the file, beside what it holds already; returns what it holds then."""
    import json

    kept = settings(path, allowed) | {k: v for k, v in changes.items() if k in allowed and _fits(v, allowed[k])}
    with open(path, "w") as f:
        json.dump(kept, f, indent=1, sort_keys=True)
    return kept
