"""What agents are told about a day: sections in order of priority within a budget of characters.

A day's counts and lines are worked out once (``day_parts``), whatever the
number of agents; an agent's own sections and budget only choose among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.text import host
from daybook.operators.context import agent_budget
from daybook.operators.stats import ok
from daybook.operators.timeline import newest_first

SECTIONS = ("apps", "urls", "meetings", "mood", "timeline")


def _counted(rows: DataFrame, column: str, name: str, top: int | None) -> DataFrame:
    """Per day the counts of a column as an array, the largest first, ties by value."""
    some = rows.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy("date", F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("date").orderBy(F.col("n").desc(), "key")))
    if top:
        some = some.where(F.col("r") <= top)
    return some.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("r", "key", "n"))).alias(name))


def day_parts(activities: DataFrame, meetings: DataFrame, *, newest: int | None = 200) -> DataFrame:
    """One row per day with analysed rows among its newest ones: what the sections are made of."""
    rows = activities
    if newest:
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("date").orderBy(*newest_first()))).where(F.col("r") <= newest).drop("r")
    rows = ok(rows)
    line = F.concat(F.lit("["), F.date_format("timestamp", "HH:mm"), F.lit("] "), F.coalesce("app_name", F.lit("?")), F.lit(" ("), F.coalesce("category", F.lit("?")), F.lit("): "), F.substring(F.coalesce("summary", F.lit("")), 1, 60), F.when(F.coalesce("active_url", F.lit("")) != "", F.concat(F.lit(" ["), host(F.col("active_url")), F.lit("]"))).otherwise(""))
    place = F.row_number().over(Window.partitionBy("date").orderBy(*newest_first()))
    base = rows.withColumn("place", place).withColumn("line", line).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    for column, name, top in (("app_name", "apps", 8), ("category", "kinds", 5), ("active_url", "urls", 10), ("mood", "moods", None)):
        base = base.join(_counted(rows, column, name, top), "date", "left")
    said = F.concat(F.lit("- "), F.date_format("start_time", "HH:mm"), F.lit(" "), F.coalesce("app_name", F.lit("?")), F.lit(" ("), F.coalesce("duration_minutes", F.lit(0.0)).cast("string"), F.lit("min): "), F.substring(F.coalesce("summary", F.lit("No summary")), 1, 80))
    m = meetings.withColumn("date", F.col("start_time").cast("date")).withColumn("said", said)
    m = m.withColumn("r", F.row_number().over(Window.partitionBy("date").orderBy(F.col("start_time").desc(), F.col("id").desc()))).where("r <= 5")
    base = base.join(m.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("r", "said"))).alias("met")), "date", "left")

    return base


def rendered(parts: DataFrame, sections: Column, budget: Column) -> DataFrame:
    """``parts`` with their text: the sections asked for, as far as the budget goes."""
    pairs = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["key"], F.lit(": "), x["n"].cast("string"))), ", ")
    out = parts.withColumn("text", F.concat(F.lit("## Data of "), F.col("date").cast("string"), F.lit("\n\n"), F.col("n").cast("string"), F.lit(" rows analysed")))
    out = out.withColumn("left", budget - F.length("text"))

    def add(df: DataFrame, name: str, least: int, section: Column, there: Column) -> DataFrame:
        """Append a section if it is asked for, has something to say, and more than ``least`` characters are left."""
        fits = F.array_contains(sections, name) & there & (F.col("left") > least)
        df = df.withColumn("_s", F.when(fits, section))
        return df.withColumns({"text": F.concat("text", F.when(F.col("_s").isNotNull(), F.concat(F.lit("\n\n"), F.col("_s"))).otherwise("")), "left": F.col("left") - F.coalesce(F.length("_s"), F.lit(0))}).drop("_s")

    out = add(out, "apps", 100, F.concat(F.lit("### Apps\n"), F.coalesce(F.nullif(pairs(F.col("apps")), F.lit("")), F.lit("No data")), F.lit("\n\n### Categories\n"), F.coalesce(F.nullif(pairs(F.col("kinds")), F.lit("")), F.lit("No data"))), F.lit(True))
    most = F.when(F.col("left") > 2000, 10).when(F.col("left") > 1000, 5).otherwise(3)
    urls = F.transform(F.slice("urls", F.lit(1), most), lambda x: F.concat(F.lit("- "), host(x["key"]), F.lit(" ("), x["n"].cast("string"), F.lit("x) "), F.substring(x["key"], 1, 80)))
    out = add(out, "urls", 100, F.concat(F.lit("### URLs\n"), F.array_join(urls, "\n")), F.col("urls").isNotNull())
    out = add(out, "meetings", 100, F.concat(F.lit("### Meetings\n"), F.array_join(F.transform("met", lambda x: x["said"]), "\n")), F.col("met").isNotNull())
    out = add(out, "mood", 80, F.concat(F.lit("### Moods\n"), pairs(F.col("moods"))), F.col("moods").isNotNull())
    fits = F.greatest(F.floor(F.col("left") / 80).cast("int"), F.lit(3))
    out = add(out, "timeline", 80, F.concat(F.lit("### Timeline\n"), F.array_join(F.transform(F.slice("lines", F.lit(1), fits), lambda x: x["line"]), "\n")), F.lit(True))
    return out.drop("left")


def day_payload(activities: DataFrame, meetings: DataFrame, *, budget: int = 12_000, sections: tuple[str, ...] = SECTIONS, newest: int | None = 200) -> DataFrame:
    """``(date, text)``: one text per day with analysed rows among its newest ones."""
    asked = F.array(*[F.lit(x) for x in sections]) if sections else F.array().cast("array<string>")
    return rendered(day_parts(activities, meetings, newest=newest), asked, F.lit(budget)).select("date", "text")


def agent_payloads(agents: DataFrame, activities: DataFrame, meetings: DataFrame, window: int, *, newest: int | None = 200, most: int = 1000) -> DataFrame:
    """``(slug, date, prompt, text, small_window)`` for every enabled markdown
    agent (``sources.agents.discover``) and day: just the sections that its file
    selects, within the budget of a model's context window; ``small_window``
    tells that the agent asks for a larger one. Agent files are few; more than
    ``most`` are an error."""
    found = agents.where(F.col("enabled") & (F.col("type") == "markdown")).select("slug", "sections", "prompt", "model_requirement").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} agents")
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    told = [F.struct(F.lit(r["slug"]).alias("slug"), texts(r["sections"]).alias("sections"), F.lit(r["prompt"]).cast("string").alias("prompt"), F.lit((r["model_requirement"] or 0) > window).alias("small_window")) for r in found]
    parts = day_parts(activities, meetings, newest=newest)
    if not told:
        return parts.where("false").select(F.lit("").alias("slug"), "date", F.lit("").alias("prompt"), F.lit("").alias("text"), F.lit(False).alias("small_window"))
    parts = parts.withColumn("agent", F.explode(F.array(*told)))
    return rendered(parts, F.col("agent.sections"), F.lit(agent_budget(window))).select("agent.slug", "date", "agent.prompt", "text", "agent.small_window")
