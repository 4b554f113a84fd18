"""Every registered journal query: a function of (spark, folder) and the SQL that says the same.

Times that a query calls "now" and days it calls "today" are parameters with
fixed values here, so that results do not depend on the clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions import text as T
from daybook.operators import context, maintain, search, stats, textindex, timeline
from daybook.sources.store import shared_dir, signature
from daybook.sources.tables import activities, dev_contexts, meetings, read, with_tables
from daybook.streaming import folds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAY, FIRST, LAST, NOW = "2024-01-15", "2024-01-05", "2024-01-20", "2024-01-20 12:00:00"
WORDS = ["thorou", "eauoi"]
PAGE_COLUMNS = ["id", "timestamp", "app_name", "category", "status", "repo_name"]


def query(name: str, sql: str | None = None, days: tuple[str, ...] = ()):
    """Register a query and its SQL. ``days``: date columns, given as text by both."""

    def keep(f):
        QUERIES[name] = (lambda spark, d: f(spark, d).withColumns({c: F.col(c).cast("string") for c in days})) if days else f
        if sql:
            shown = ", ".join(f"{c}::date::varchar as {c}" for c in days)
            ORACLES[name] = f"select * replace ({shown}) from ({with_tables(sql)})" if days else with_tables(sql)
        return f

    return keep


def _vector(spark: SparkSession, d: str) -> list[float]:
    """The query vector: a stored one."""
    return [float(x) for x in read(spark, d, "embeddings").where("vec_id = 7").first()["embedding"]]


def _index(spark: SparkSession, d: str) -> textindex.TextIndex:
    """The stored text index of the activities, built when their tables have changed."""
    sign = signature(spark, *(f"{d}/{name}.parquet" for name in ("events", "documents")))
    rows = activities(spark, d, "cell")  # events show few texts many times: a row carries the text's key, a text comes once
    texts = read(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("text")).unionByName(activities(spark, d).select(F.col("app_name").alias("text")).distinct())
    texts = texts.unionByName(spark.range(1).select(F.lit("").alias("text")))
    source = textindex.Source(rows.select("id", F.array("cell", textindex.cell(F.col("app_name"))).alias("cells")), texts.select(F.coalesce("text", F.lit("")).alias("text")))
    return textindex.ensure(source, ["ocr_text", "app_name"], f"{shared_dir(spark)}/activity-texts", sign)


def _document_index(spark: SparkSession, d: str) -> textindex.TextIndex:
    return textindex.ensure(read(spark, d, "documents"), ["text", "source"], f"{shared_dir(spark)}/document-texts", signature(spark, f"{d}/documents.parquet"), "doc_id")


_OK = "status = 'ok'"

# ------------------------------------------------------------------ statistics


@query("stats_by_category", f"select category, count(*) as n from activities where {_OK} group by 1")
def _(spark, d):
    return stats.count_by(stats.ok(activities(spark, d)), "category")


@query("top_apps", f"select app_name, count(*) as n from activities where {_OK} group by 1 order by n desc, 1 limit 10")
def _(spark, d):
    return stats.count_by(stats.ok(activities(spark, d)), "app_name", top=10)


@query("top_repos", "select repo_name, count(*) as n from dev_contexts d join activities a on a.id = d.activity_id where repo_name <> '' group by 1 order by n desc, 1 limit 10")
def _(spark, d):
    return stats.top_repos(dev_contexts(spark, d), activities(spark, d))


@query("status_breakdown", "select coalesce(status, 'pending') as status, count(*) as n from activities group by 1")
def _(spark, d):
    return stats.status_breakdown(activities(spark, d))


@query("meeting_totals", "select count(*) as n, coalesce(sum(duration_minutes), 0)::double as minutes from meetings")
def _(spark, d):
    return stats.meeting_totals(meetings(spark, d))


@query(
    "stats_combined",
    f"""with a as (select * from activities where date between '{FIRST}' and '{LAST}'), m as (select * from meetings where start_time::date between '{FIRST}' and '{LAST}')
    select 'total' as metric, '' as key, count(*)::double as value from a where {_OK}
    union all select 'category', category, count(*)::double from a where {_OK} group by 2
    union all (select 'app', app_name, count(*)::double as n from a where {_OK} group by 2 order by n desc, 2 limit 10)
    union all (select 'repo', repo_name, count(*)::double as n from dev_contexts d join a on a.id = d.activity_id group by 2 order by n desc, 2 limit 10)
    union all select 'status', status, count(*)::double from a group by 2
    union all select 'meetings', 'count', count(*)::double from m
    union all select 'meetings', 'minutes', coalesce(sum(duration_minutes), 0)::double from m""",
)
def _(spark, d):
    return stats.combined(activities(spark, d), dev_contexts(spark, d), meetings(spark, d), FIRST, LAST)


@query("hour_heatmap", f"select dayofweek(timestamp)::integer as weekday, hour(timestamp)::integer as hour, count(*) as n from activities where {_OK} group by 1, 2")
def _(spark, d):
    return stats.heatmap(activities(spark, d))


@query(
    "storage_span",
    """select active_days, first_date, last_date, n, days, 1500.0::double / greatest(active_days, 1) * days as mb
    from (select count(distinct date) as active_days, min(date) as first_date, max(date) as last_date, count(*) as n from activities),
    (select unnest([1, 7, 30, 90, 365])::integer as days)""", days=('first_date', 'last_date'))
def _(spark, d):
    return stats.storage_estimate(activities(spark, d), 1500.0)


@query("category_counter", f"select coalesce(nullif(category, ''), 'other') as category, count(*) as n from activities where {_OK} group by 1")
def _(spark, d):
    return stats.category_counter(activities(spark, d))


@query(
    "repos_of_newest",
    f"""with j as (select a.*, repo_name, row_number() over (partition by a.date order by a.timestamp desc, a.id desc) as r from activities a left join dev_contexts d on d.activity_id = a.id),
    c as (select date, repo_name, count(*) as n, max(row(timestamp, id)) as last from j where r <= 200 and {_OK} and repo_name <> '' group by 1, 2),
    p as (select date, repo_name, n, row_number() over (partition by date order by n desc, last desc)::integer as place from c)
    select * from p where place <= 5""", days=('date',))
def _(spark, d):
    return stats.repos_of_newest(activities(spark, d), dev_contexts(spark, d))


_PRODUCTIVE_SQL = """with {src} g as (select date, epoch_us(timestamp) - epoch_us(lag(timestamp) over (partition by date order by timestamp, id)) as gap
    from {table} where status = 'ok' and lower(category) in ('coding', 'writing', 'terminal', 'design', 'meeting'))
    select date, sum(coalesce(least(gap, 80000000), 40000000))::bigint as micros from g group by 1"""


@query("productive_hours", _PRODUCTIVE_SQL.format(src="", table="activities"), days=('date',))
def _(spark, d):
    return stats.productive_seconds(activities(spark, d))


@query("productive_hours_newest", _PRODUCTIVE_SQL.format(src="t as (select * from (select *, row_number() over (partition by date order by timestamp desc, id desc) as r from activities) where r <= 200),", table="t"), days=('date',))
def _(spark, d):
    return stats.productive_seconds(activities(spark, d), newest=200)


_URLS = "select active_url as url, count(*) as visits, arg_max(app_name, row(timestamp, id)) as app_name, max(timestamp) as last_visit from {t} group by 1"


@query("url_visits", f"with t as (select * from activities where active_url <> '' order by timestamp desc, id desc limit 200) {_URLS.format(t='t')}")
def _(spark, d):
    return stats.url_visits(activities(spark, d, "url"))


@query("url_visits_all", f"with t as (select * from activities where active_url <> '') {_URLS.format(t='t')}")
def _(spark, d):
    return stats.url_visits(activities(spark, d, "url"), None)


@query("app_usage", "with t as (select * from activities order by timestamp desc, id desc limit 200) select coalesce(app_name, 'Unknown') as app_name, count(*) as captures, string_agg(distinct category, ',' order by category) as categories from t group by 1")
def _(spark, d):
    return stats.app_usage(activities(spark, d))


@query("app_usage_all", "select coalesce(app_name, 'Unknown') as app_name, count(*) as captures, string_agg(distinct category, ',' order by category) as categories from activities group by 1")
def _(spark, d):
    return stats.app_usage(activities(spark, d), None)


@query("url_summaries", "with t as (select * from activities where active_url <> '') select active_url as url, count(*) as visits, arg_max(app_name, row(timestamp, id)) as app_name, max(timestamp) as last_visit, max(row(timestamp, id, summary))[3] as summary from t group by 1")
def _(spark, d):
    return stats.url_visits(activities(spark, d, "url", "text"), None)


@query(
    "agent_facets",
    f"""with t as (select * from activities where {_OK})
    (select 'app' as facet, app_name as key, count(*) as n from t group by 2 order by n desc, 2 limit 8)
    union all (select 'category', category, count(*) as n from t group by 2 order by n desc, 2 limit 5)
    union all (select 'mood', mood, count(*) from t where mood <> '' group by 2)
    union all (select 'url', active_url, count(*) as n from t where active_url <> '' group by 2 order by n desc, 2 limit 10)""",
)
def _(spark, d):
    return stats.facets(activities(spark, d, "url"))


@query("mood_breakdown", f"select mood, count(*) as n from activities where {_OK} and mood is not null group by 1")
def _(spark, d):
    return stats.count_by(stats.ok(activities(spark, d)).where("mood is not null"), "mood")


@query("overview", f"select count(*) as n, count(*) filter (where {_OK}) as analysed, count(distinct app_name) as apps, count(*) * 30 as seconds_tracked, (select category from activities where {_OK} group by 1 order by count(*) desc, 1 limit 1) as top_category from activities")
def _(spark, d):
    return stats.overview(activities(spark, d))


@query("transcripts", "select id, transcript, duration_minutes from meetings")
def _(spark, d):
    return meetings(spark, d).select("id", "transcript", "duration_minutes")


@query("meeting_minutes", "select id, round(date_diff('second', start_time, end_time) / 60.0, 1)::double as minutes from meetings where end_time is not null")
def _(spark, d):
    seconds = (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 1e6
    return meetings(spark, d).where("end_time is not null").select("id", F.round(seconds / 60, 1).alias("minutes"))


# -------------------------------------------------------------------- timeline


def _page(sql_tail: str) -> str:
    return f"select a.id, a.timestamp, a.app_name, a.category, a.status, d.repo_name from activities a left join dev_contexts d on d.activity_id = a.id where a.date = '{DAY}' order by a.timestamp desc, a.id desc {sql_tail}"


@query("timeline_page", _page("limit 100 offset 50"))
def _(spark, d):
    return timeline.page(activities(spark, d), dev_contexts(spark, d), DAY, 100, 50).select(*PAGE_COLUMNS)


@query("timeline_since", f"select * from ({_page('limit 100')}) where strftime(timestamp, '%Y-%m-%d %H:%M:%S') > '{DAY} 20:00:00'")
def _(spark, d):
    return timeline.page(activities(spark, d), dev_contexts(spark, d), DAY, 100, since=f"{DAY} 20:00:00").select(*PAGE_COLUMNS)


@query("activity_lookup", "select a.id, a.timestamp, a.app_name, d.repo_name, d.branch from activities a left join dev_contexts d on d.activity_id = a.id where a.id = 123")
def _(spark, d):
    return timeline.with_context(activities(spark, d).where("id = 123"), dev_contexts(spark, d)).select("id", "timestamp", "app_name", "repo_name", "branch")


@query("bookmarks", "select id, timestamp, app_name from activities where bookmarked order by timestamp desc, id desc limit 50")
def _(spark, d):
    return timeline.bookmarks(activities(spark, d)).select("id", "timestamp", "app_name")


@query("rewind", f"select id, timestamp, app_name, category, summary, bookmarked, status from activities where date = '{DAY}'")
def _(spark, d):
    return timeline.rewind(activities(spark, d, "text"), DAY)


@query("recent_activity", f"select id, timestamp, app_name, category from activities where {_OK} order by timestamp desc, id desc limit 50")
def _(spark, d):
    return timeline.recent(activities(spark, d), 80).select("id", "timestamp", "app_name", "category")


@query("last_minutes", f"select id, timestamp from (select * from activities where date = '2024-01-20' order by timestamp desc, id desc limit 50) where timestamp >= timestamp '{NOW}' - interval 600 minute")
def _(spark, d):
    return timeline.last_minutes(activities(spark, d), NOW, 600).select("id", "timestamp")


@query("activities_by_hour_range", f"select id, timestamp, app_name from activities where {_OK} and date = '{DAY}' and hour(timestamp) between 9 and 17 order by timestamp, id limit 100")
def _(spark, d):
    return timeline.by_hours(activities(spark, d), DAY, 9, 17).select("id", "timestamp", "app_name")


@query(
    "hour_range_summary",
    f"select count(*) as n, string_agg(distinct app_name, ',' order by app_name) as apps, string_agg(distinct category, ',' order by category) as categories, min(timestamp) as first_time, max(timestamp) as last_time from activities where {_OK} and date = '{DAY}' and hour(timestamp) between 9 and 17",
)
def _(spark, d):
    return stats.summary_of(timeline.by_hours(activities(spark, d), DAY, 9, 17, None))


@query("sdk_filter", "select id, timestamp, active_url, substr(ocr_text, 1, 500) as ocr_text from activities where date = '2024-01-15' and category = 'browsing' and active_url ilike '%example.org%' order by timestamp desc, id desc limit 100")
def _(spark, d):
    return timeline.select_where(activities(spark, d, "url", "text"), date=DAY, category="browsing", url_contains="EXAMPLE.org", has_url=True).select("id", "timestamp", "active_url", "ocr_text")


@query("unanalyzed_backlog", "select id, timestamp from activities where status = 'pending' order by timestamp, id limit 10")
def _(spark, d):
    return timeline.unanalysed(activities(spark, d)).select("id", "timestamp")


@query("retry_backlog", f"select id, timestamp, status from activities where date = '{DAY}' and status in ('pending', 'skipped', 'failed')")
def _(spark, d):
    return timeline.retryable(activities(spark, d), DAY).select("id", "timestamp", "status")


@query("voice_memos", f"select id, timestamp, status from activities where date = '{DAY}' and app_name = 'Voice Memo'")
def _(spark, d):
    return timeline.memos(activities(spark, d), DAY).select("id", "timestamp", "status")


@query("detected_memos", f"select id, timestamp, status from activities where date = '{DAY}' and (app_name = 'Voice Memo' or id % 41 = 0)")
def _(spark, d):
    a = activities(spark, d).withColumn("detected_app", F.when(F.col("id") % 41 == 0, "Voice Memo"))
    return timeline.memos(a, DAY).select("id", "timestamp", "status")


@query("never_analysed", "select id, timestamp from activities where id % 3 = 0 order by timestamp, id limit 10")
def _(spark, d):
    a = activities(spark, d).withColumn("analyzed", F.when(F.col("id") % 3 != 0, True))
    return timeline.unanalysed(a).select("id", "timestamp")


@query("relative_range", f"select date, count(*) as n from activities where date between date '{DAY}' - 6 and '{DAY}' group by 1", days=('date',))
def _(spark, d):
    return stats.count_by(stats.in_range(activities(spark, d), *timeline.relative_range("7d", DAY)), "date")


@query("meetings_by_day", "select id, start_time, app_name from meetings where start_time::date = '2024-01-05'")
def _(spark, d):
    return meetings(spark, d).where("cast(start_time as date) = date'2024-01-05'").orderBy(F.col("start_time").desc(), F.col("id").desc()).select("id", "start_time", "app_name")


@query("meetings_then_activities", "select 0 as part, id::varchar as id, start_time as timestamp from meetings where start_time::date = '2024-01-05' union all select 1, id::varchar, timestamp from activities where date = '2024-01-05'")
def _(spark, d):
    m = meetings(spark, d).where("cast(start_time as date) = date'2024-01-05'").select(F.lit(0).alias("part"), F.col("id").cast("string").alias("id"), F.col("start_time").alias("timestamp"))
    a = activities(spark, d).where("date = date'2024-01-05'").select(F.lit(1).alias("part"), F.col("id").cast("string").alias("id"), "timestamp")
    return m.unionByName(a).orderBy("part", F.col("timestamp").desc(), "id")


@query("blocked_apps", "select count(*) as n from activities where lower(app_name) not in ('app_1', 'voice memo')")
def _(spark, d):
    return activities(spark, d).where(~timeline.blocked(F.col("app_name"), ("App_1", "Voice Memo"))).agg(F.count(F.lit(1)).alias("n"))


@query("app_words", "select count(*) as n from activities where contains(lower(app_name), 'memo') or contains(lower(app_name), 'app_1')")
def _(spark, d):
    return activities(spark, d).where(timeline.any_of(F.col("app_name"), ("memo", "app_1"))).agg(F.count(F.lit(1)).alias("n"))


@query("staleness_skip", f"select id from activities where not bookmarked and timestamp < timestamp '{NOW}' - interval 180 second")
def _(spark, d):
    return timeline.stale(activities(spark, d), NOW).select("id")


@query("latest_per_key", "select app_name, id, timestamp from (select *, row_number() over (partition by app_name order by timestamp desc, id desc) as r from activities) where r = 1")
def _(spark, d):
    return timeline.latest_per(activities(spark, d), "app_name").select("app_name", "id", "timestamp")


@query("keep_newest_n", "select id from activities order by timestamp desc, id desc limit 200")
def _(spark, d):
    return timeline.keep_newest(activities(spark, d), 200).select("id")


@query("keep_newest_per_key", "select user_id, id from (select *, row_number() over (partition by user_id order by timestamp desc, id desc) as r from activities) where r <= 30")
def _(spark, d):
    return timeline.keep_newest(activities(spark, d), 30, "user_id").select("user_id", "id")


_RUNS = """with c as (select *, case when app_name is distinct from lag(app_name) over w then 1 else 0 end as c from activities window w as (partition by user_id order by timestamp, id)),
    r as (select *, sum(c) over (partition by user_id order by timestamp, id) as run from c)
    select user_id, run::bigint as run, min(app_name) as app_name, min(timestamp) as first_time, max(timestamp) as last_time, count(*) as n from r group by 1, 2"""


@query("session_islands", _RUNS)
def _(spark, d):
    return timeline.app_runs(activities(spark, d))


@query(
    "quiet_sessions",
    """with c as (select *, coalesce((epoch_us(timestamp) - epoch_us(lag(timestamp) over (partition by user_id order by timestamp, id)) >= 21600000000)::integer, 1) as c from activities),
    r as (select *, sum(c) over (partition by user_id order by timestamp, id) as burst from c)
    select user_id, burst::bigint as burst, arg_max(id, row(timestamp, id)) as id, count(*) as n from r group by 1, 2""",
)
def _(spark, d):
    return timeline.quiet_sessions(activities(spark, d), 21600)


# ------------------------------------------------------------------------ text

_CARD = r"\b(?:\d{4}[\s\-]?){3}\d{4}\b"
_PASS = r"(?i)(?:password|passwd|pwd|secret|token|api.?key)\s*[:=]\s*[\"'']?(\S{4,})[\"'']?"
_MAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}\b"


@query(
    "redact_text",
    rf"""with t as (select doc_id, coalesce(text, '') as text from documents)
    select doc_id, regexp_replace(regexp_replace(text, '{_PASS}', '[REDACTED:password]', 'g'), '{_MAIL}', '[REDACTED:email]', 'g') as clean_text,
        (len(regexp_extract_all(text, '{_PASS}')) + len(regexp_extract_all(regexp_replace(text, '{_PASS}', '[REDACTED:password]', 'g'), '{_MAIL}')))::integer as redacted_count from t""",
)
def _(spark, d):
    r = T.redact(F.col("text"), ("ssn", "api_key", "jwt", "password", "email"))
    return read(spark, d, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.clean_text", "r.redacted_count")


@query(
    "redaction_counts",
    rf"""with c as (select doc_id, unnest(regexp_extract_all(text, '{_CARD}')) as card from documents),
    x as (select doc_id, list_transform(string_split(reverse(regexp_replace(card, '[^0-9]', '', 'g')), ''), lambda v: v::integer) as v from c),
    s as (select doc_id, list_sum(list_transform(v, lambda q, i: case when i % 2 = 1 then q when q > 4 then 2 * q - 9 else 2 * q end)) % 10 = 0 as good from x)
    select doc_id, count(*)::integer as found, count(*) filter (where good)::integer as cards from s group by 1""",
)
def _(spark, d):
    found = T.matches(F.col("text"), T.CARD)
    rows = read(spark, d, "documents").select("doc_id", F.size(found).alias("found"), F.get(T.redact(F.col("text"), ("credit_card",))["details"], F.lit(0))["count"].alias("cards"))
    return rows.where("found > 0")


@query("redact_cards", None)
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", T.redact(F.col("text"))["clean_text"].alias("clean_text"))


@query(
    "url_extract",
    r"""with u as (select page_id, regexp_extract_all(replace(html || ' seen at ' || url || '. and (' || url || ')', 'www.', 'w3.'), '(?i)https?://[^\s<>"'']+') as m from pages),
    e as (select page_id, list_filter(list_transform(m, lambda x: regexp_replace(x, '[.,;:)\]''"]+$', '')), lambda x: len(x) >= 10 and not starts_with(x, 'http://localhost')) as m from u)
    select page_id, array_to_string(list_filter(m, lambda x, i: list_position(list_transform(m, lambda y: lower(y)), lower(x)) = i), ' ') as urls from e""",
)
def _(spark, d):
    said = F.concat("html", F.lit(" seen at "), "url", F.lit(". and ("), "url", F.lit(")"))
    return read(spark, d, "pages").select("page_id", F.array_join(T.urls(F.replace(said, F.lit("www."), F.lit("w3."))), " ").alias("urls"))


@query("url_host", "select page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) as host from pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", T.host(F.col("url")).alias("host"))


_STOP = "'what', 'should', 'would', 'could', 'will', 'shall', 'how', 'why', 'when', 'where', 'which', 'who', 'whom', 'that', 'this', 'these', 'those', 'have', 'has', 'had', 'does', 'did', 'doing', 'done', 'the', 'and', 'but', 'for', 'not', 'you', 'your', 'yours', 'they', 'them', 'their', 'was', 'were', 'been', 'being', 'are', 'can', 'may', 'might', 'must', 'need', 'with', 'from', 'about', 'into', 'over', 'after', 'before', 'between', 'reply', 'respond', 'tell', 'say', 'said', 'ask', 'asked', 'show', 'see', 'look', 'find', 'get', 'got', 'give', 'gave', 'last', 'recent', 'latest', 'happening', 'going', 'any', 'some', 'there', 'also', 'just', 'like', 'know', 'to', 'do', 'me', 'my', 'is', 'it', 'in', 'on', 'at', 'if', 'so', 'or', 'no', 'up', 'an', 'be', 'am', 'of', 'i', 'next', 'now', 'then', 'than', 'too', 'message', 'messages', 'text', 'send', 'sent', 'chat', 'mail', 'email', 'wrote', 'write', 'writing', 'hi', 'hii', 'hey', 'hello', 'please', 'yeah', 'yes', 'thanks', 'thank', 'okay', 'ok', 'cool', 'nice'"  # as SQL has it


@query(
    "keywords",
    rf"""select conv_id, turn, array_to_string(list_filter(list_transform(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda w: regexp_replace(w, '^[?!.,;:''"]+|[?!.,;:''"]+$', '', 'g')),
    lambda w: len(w) > 1 and w not in ({_STOP})), ' ') as words from conversations""",
)
def _(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.keywords(F.col("text")), " ").alias("words"))


@query("vocab", r"select doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: len(w) > 2))), ' ') as words from documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", T.vocabulary(F.col("text")).alias("words"))


@query("embedding_text", "select id, concat_ws('. ', nullif(summary, ''), 'Application: ' || app_name, 'Category: ' || category) as text from activities")
def _(spark, d):
    none = F.lit(None).cast("string")
    return activities(spark, d, "text").select("id", T.embedding_text(F.col("summary"), none, none, F.col("app_name"), F.col("category"), F.lit(None).cast("array<string>")).alias("text"))


@query("auto_bookmark", "select doc_id, case when contains(lower(text), 'deadline') then 'deadline' when contains(lower(text), 'idiot') then 'idiot' when contains(lower(text), 'token') then 'token' end as keyword from documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", T.first_keyword(F.col("text"), ["deadline", " Idiot", "token"]).alias("keyword"))


@query("text_chunks", "select doc_id, i::integer as i, case when length(text) > 4000 then substr(text, i * 3000 + 1, 3000) else text end as chunk from (select doc_id, text, unnest(range(0, case when length(text) > 4000 then ceil(length(text) / 3000.0)::bigint else 1 end)) as i from documents)")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("i", "chunk"))


@query("highlight", "select doc_id, regexp_replace(text, '(thorou|eauoi)', '<mark>\\1</mark>', 'gi') as text from documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", T.highlight(F.col("text"), "thorou of eauoi").alias("text"))


@query("matching_lines", "select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: len(trim(x)) > 2 and (contains(lower(x), 'thorou') or contains(lower(x), 'eauoi')))[1:10], chr(10)) as lines from documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(T.matching_lines(F.col("text"), WORDS), "\n").alias("lines"))


@query("short_text", "select doc_id, case when length(text) > 60 then substr(text, 1, 60) || '...' else text end as text from documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", T.shorten(F.col("text"), 60).alias("text"))


@query("safe_names", "select page_id, coalesce(nullif(regexp_replace(url, '[^a-zA-Z0-9_-]', '', 'g'), ''), 'unknown') as name from pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


_AGENTS = "select event_id as id, case event_id % 4 when 0 then 'every ' || (event_id % 60) || 'm' when 1 then 'every ' || (event_id % 9 + 1) || 'h' when 2 then 'Daily at nine' else 'sometimes' end as schedule, ts, event_id % 5 <> 0 as enabled from events"
_SECONDS = "case when schedule like 'every %m' then regexp_extract(schedule, '([0-9]+)', 1)::integer * 60 when schedule like 'every %h' then regexp_extract(schedule, '([0-9]+)', 1)::integer * 3600 when lower(schedule) like '%daily%' then 86400 else 21600 end"


def _agents(spark, d):
    i = F.col("event_id")
    schedule = F.when(i % 4 == 0, F.concat(F.lit("every "), (i % 60).cast("string"), F.lit("m"))).when(i % 4 == 1, F.concat(F.lit("every "), (i % 9 + 1).cast("string"), F.lit("h"))).when(i % 4 == 2, "Daily at nine").otherwise("sometimes")
    return read(spark, d, "events").select(i.alias("id"), schedule.alias("schedule"), F.col("ts").alias("last_run"), (i % 5 != 0).alias("enabled"))


@query("schedule_seconds", f"with a as ({_AGENTS}) select id, {_SECONDS} as seconds from a")
def _(spark, d):
    return _agents(spark, d).select("id", T.schedule_seconds(F.col("schedule")).alias("seconds"))


@query("due_agents", f"with a as ({_AGENTS}) select id from a where enabled and epoch_us(timestamp '{NOW}') - epoch_us(ts) >= {_SECONDS}::bigint * 1000000")
def _(spark, d):
    return context.due(_agents(spark, d).withColumn("seconds", T.schedule_seconds(F.col("schedule"))), NOW).select("id")


@query("confidence", "select id, greatest(0.0, least(1.0, case when c = 0 and summary <> '' and not contains(lower(summary), 'failed') then 0.7 else c end))::double as confidence from (select id, summary, (id % 7 - 1)::double / 4 as c from activities)")
def _(spark, d):
    return activities(spark, d, "text").select("id", T.adjusted_confidence((F.col("id") % 7 - 1).cast("double") / 4, F.col("summary")).alias("confidence"))


@query("hash_distance", "select event_id, bit_count(xor(event_id * 2654435761, user_id * 40503))::integer as bits from events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", T.hamming(F.col("event_id") * 2654435761, F.col("user_id") * 40503).alias("bits"))


# ---------------------------------------------------------------------- search

_TOKENS = f"regexp_extract_all(translate(lower(coalesce({{c}}, '')), '{search.MARKED}', '{search.PLAIN}'), '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"
_WT = _TOKENS.format(c="text").replace("{{", "{").replace("}}", "}")


def _bm25_sql(table: str, id_col: str, columns: list[str], phrases: list[list[str]]) -> str:
    """Scores of ``table`` as common table expressions; the last is ``bm``."""
    words = ", ".join(_TOKENS.format(c=c).replace("{{", "{").replace("}}", "}") + f" as w{i}" for i, c in enumerate(columns))

    def hits(i: int, phrase: list[str]) -> str:
        if len(phrase) == 1:
            return f"len(list_filter(w{i}, lambda x: x = '{phrase[0]}'))"
        want = "[" + ", ".join(f"'{p}'" for p in phrase) + "]"
        return f"len(list_filter(range(1, len(w{i}) - {len(phrase) - 2}), lambda k: w{i}[k:k + {len(phrase) - 1}] = {want}))"

    fs = ", ".join("(" + " + ".join(hits(i, p) for i in range(len(columns))) + f") as f{j}" for j, p in enumerate(phrases))
    size = " + ".join(f"len(w{i})" for i in range(len(columns)))
    ns = ", ".join(f"count(*) filter (where f{j} > 0) as n{j}" for j in range(len(phrases)))
    score = " ".join(
        f"- (case when ln((cn - n{j} + 0.5) / (n{j} + 0.5)) <= 0 then 1e-6::double else ln((cn - n{j} + 0.5) / (n{j} + 0.5)) end) * f{j} * 2.2::double / (f{j} + 1.2::double * (0.25::double + 0.75::double * dl / (total::double / cn)))"
        for j in range(len(phrases))
    )
    some = " or ".join(f"f{j} > 0" for j in range(len(phrases)))
    return f"bw as (select {id_col} as id, {words} from {table}), bs as (select id, ({size}) as dl, {fs} from bw), bt as (select count(*) as cn, sum(dl) as total, {ns} from bs), bm as (select id, (0 {score})::double as score from bs, bt where {some})"


def _bm25(columns, phrases):
    return lambda spark, d: search.bm25(None, columns, phrases, index=_document_index(spark, d)).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


for _name, _columns, _phrases in (("bm25_term", ["text", "source"], [["thorou"]]), ("bm25_or", ["text", "source"], [["thorou"], ["src3"], ["the"]]), ("bm25_phrase", ["text", "source"], [["of", "the"]])):
    query(_name, f"with {_bm25_sql('documents', 'doc_id', _columns, _phrases)} select id as doc_id, round(score, 6) as score from bm")(_bm25(_columns, _phrases))


@query("postings", f"select word as term, doc_id, count(*) as n from (select doc_id, unnest({_WT}) as word from documents) group by 1, 2")
def _(spark, d):
    index = _document_index(spark, d)
    rows = index.table("rows").where(F.col("column") == 0).select(F.col("id").alias("doc_id"), "key")
    # every word of every row: texts meet their rows, and words are counted inside a text
    texts = index.table("texts").select("key", "said")
    texts = texts if len(index.segments) == 1 else texts.groupBy("key").agg(F.first("said").alias("said"))
    held = rows.join(texts, "key").select("doc_id", F.inline(textindex.places(F.col("said"))))
    return held.select("term", "doc_id", F.size("positions").cast("long").alias("n"))


@query("bm25_scan", f"with {_bm25_sql('documents', 'doc_id', ['text'], [['thorou'], ['of', 'the']])} select id as doc_id, round(score, 6) as score from bm")
def _(spark, d):
    """The same scores without an index."""
    return search.bm25(read(spark, d, "documents"), ["text"], [["thorou"], ["of", "the"]], "doc_id").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("index_differences", "select doc_id as id, case when doc_id % 10 = 0 then 'missing' when doc_id % 10 = 2 then 'stale' else 'extra' end as problem from documents where doc_id % 10 in (0, 1, 2)")
def _(spark, d):
    """The index of a table that lacks some rows, has lost some since, and knows others with another text."""
    docs = read(spark, d, "documents")
    known = docs.where("doc_id % 10 <> 0").withColumn("source", F.when(F.col("doc_id") % 10 == 2, "other").otherwise(F.col("source")))
    index = textindex.ensure(known, ["text", "source"], f"{shared_dir(spark)}/known-texts", signature(spark, f"{d}/documents.parquet"), "doc_id")
    return textindex.differences(index, docs.where("doc_id % 10 <> 1"), "doc_id")


_DOT = "list_sum(list_transform(list_zip(embedding, (select embedding from embeddings where vec_id = 7)), lambda p: p[1]::double * p[2]::double))"


def _near_sql(name: str, where: str, top: int, newest: str = " order by timestamp desc, id desc limit 500") -> str:
    return f"""{name}_c as (select * from activities where {where} and embedding is not null{newest}),
    {name}_s as (select *, {_DOT} as similarity from {name}_c), {name} as (select * from {name}_s where similarity > 0.1 order by similarity desc, id desc limit {top})"""


@query("vector_topk", f"with {_near_sql('s', _OK, 20)} select id, round(similarity, 3)::double as relevance from s")
def _(spark, d):
    return search.nearest(stats.ok(activities(spark, d, "embedding")), _vector(spark, d), 20, cap=500).select("id", F.round("similarity", 3).alias("relevance"))


@query("vector_topk_all", f"with s as (select id, {_DOT} as similarity from activities where {_OK}) select id, round(similarity, 3)::double as relevance from s where similarity > 0.1 order by similarity desc, id desc limit 20")
def _(spark, d):
    return search.nearest(stats.ok(activities(spark, d, "embedding")), _vector(spark, d), 20).select("id", F.round("similarity", 3).alias("relevance"))


_KEY = _bm25_sql("activities", "id", ["ocr_text", "app_name"], [["thorou"]])
_SNIP = "case when strpos(lower(transcript), 'thorou') > 0 then (case when strpos(lower(transcript), 'thorou') - 1 > {a} then '...' else '' end) || substr(transcript, greatest(strpos(lower(transcript), 'thorou') - {a}, 1), least(length(transcript), strpos(lower(transcript), 'thorou') - 1 + 6 + {a}) - greatest(strpos(lower(transcript), 'thorou') - 1 - {a}, 0)) || (case when strpos(lower(transcript), 'thorou') - 1 + 6 + {a} < length(transcript) then '...' else '' end) else substr(coalesce(transcript, ''), 1, {b}) end"
_MET = "(contains(lower(transcript), 'thorou') or coalesce(contains(lower(summary), 'thorou'), false))"


@query(
    "hybrid_search",
    f"""with {_near_sql('s', _OK, 20, '')}, {_KEY}, k0 as (select bm.id, score from bm join activities a on a.id = bm.id where a.status = 'ok' order by score, bm.id limit 20),
    k1 as (select id, round(0.7 - (row_number() over (order by score, id) - 1) * 0.4 / greatest((select count(*) from k0) - 1, 1), 3) as kw from k0),
    b as (select coalesce(s.id, k1.id) as id, round(similarity, 3) as sem, kw from s full join k1 on k1.id = s.id),
    r as (select id::varchar as id, (case when sem is not null and kw is not null then least(sem + 0.1, 1.0) else coalesce(sem, kw) end)::double as relevance,
        case when sem is not null and kw is not null then 'hybrid' when sem is not null then 'semantic' else 'keyword' end as match_type from b
     union all select * from (select 'meeting-' || id, 0.6::double, 'meeting' from meetings where {_MET} order by start_time desc, id desc limit 20))
    select id, relevance, match_type from r order by relevance desc, match_type, id limit 20""",
)
def _(spark, d):
    return search.hybrid(activities(spark, d, "embedding"), meetings(spark, d), ["ocr_text", "app_name"], "thorou", _vector(spark, d), index=_index(spark, d), known=activities(spark, d))


@query(
    "agent_tool_search",
    f"""with {_near_sql('s', _OK, 10, '')}, {_KEY}, k0 as (select bm.id, score from bm join activities a on a.id = bm.id where a.status = 'ok' order by score, bm.id limit 10),
    r as (select id, round(similarity, 3)::double as relevance, 'semantic' as match from s union all select id, 0.5::double, 'keyword' from k0 where id not in (select id from s))
    select * from r order by relevance desc, match desc, id limit 10""",
)
def _(spark, d):
    return search.tool_search(activities(spark, d, "embedding"), ["ocr_text", "app_name"], "thorou", _vector(spark, d), index=_index(spark, d), known=activities(spark, d))


_CHAT = f"""{_bm25_sql('activities', 'id', ['ocr_text', 'app_name'], [['thorou'], ['eauoi']])}, h as (select id, (row_number() over (order by score, id) - 1) as place from bm order by score, id limit 25),
    f as (select a.*, h.place from activities a join h on h.id = a.id where a.status = 'ok'),
    nw as (select * from activities where {_OK} and embedding is not null order by timestamp desc, id desc limit 10),
    mr as (select *, row_number() over (order by timestamp desc, id desc) as r from nw where id not in (select id from f)),
    cand as (select id, timestamp, embedding, place from f union all select id, timestamp, embedding, null from mr where (select count(*) from f) < 3 and (select count(*) from f) + r <= 10)"""


@query("chat_candidates", f"with {_CHAT} select id, place::integer as place from cand")
def _(spark, d):
    return search.chat_candidates(activities(spark, d, "embedding"), ["ocr_text", "app_name"], WORDS, index=_index(spark, d)).select("id", "place")


@query(
    "chat_rerank",
    f"""with {_CHAT}, sc as (select *, {_DOT} as similarity from cand), nr as (select *, row_number() over (order by similarity desc, id desc) as near from sc),
    rr as (select id, timestamp, case when near <= 5 and similarity > 0.1 then round(similarity * 0.7::double + 0.2::double / (1.0::double + greatest((epoch_us(timestamp '{NOW}') - epoch_us(timestamp)) / 3.6e9::double, 0) * 0.05::double)
        + 0.1::double * (0.1::double * (1.0::double - coalesce(place, 25) / 25.0::double)), 3) else 0.05::double end as relevance from nr)
    select id, timestamp, relevance from rr order by relevance desc, timestamp desc, id desc limit 5""",
)
def _(spark, d):
    found = search.chat_candidates(activities(spark, d, "embedding"), ["ocr_text", "app_name"], WORDS, index=_index(spark, d))
    return search.rerank(found, _vector(spark, d), NOW, 25)


@query("chat_fallback", f"with {_near_sql('s', _OK, 5)} select id, round(similarity, 3)::double as relevance from s where (select max(round(similarity, 3)) from s) >= 0.35")
def _(spark, d):
    return search.fallback(activities(spark, d, "embedding"), _vector(spark, d))


for _name, _around, _else in (("meeting_snippets", 80, 200), ("tool_meeting_snippets", 100, 300)):
    query(_name, f"select id, start_time, {_SNIP.format(a=_around, b=_else)} as snippet from meetings where {_MET} order by start_time desc, id desc limit 20")(lambda spark, d, a=_around, b=_else: search.meeting_hits(meetings(spark, d), "Thorou", 20, around=a, otherwise=b).select("id", "start_time", "snippet"))

# ----------------------------------------------------------------- maintenance


@query("analysis_update", "select a.id, case when n.event_id is not null then n.event_type else a.category end as category, case when n.event_id is not null then 'ok' else a.status end as status from activities a left join (select * from events where event_id % 13 = 0) n on n.event_id = a.id")
def _(spark, d):
    new = read(spark, d, "events").where("event_id % 13 = 0").select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.lit("ok").alias("status"))
    return maintain.merge_by(activities(spark, d).select("id", "category", "status"), new, "id", ["category", "status"])


@query("bookmark_toggle", "select id, case when id in (17, 18, 19) then not bookmarked else bookmarked end as bookmarked from activities")
def _(spark, d):
    return maintain.toggle(activities(spark, d), [17, 18, 19]).select("id", "bookmarked")


def _daily(spark, d, *, late: bool):
    a = activities(spark, d)
    some = a.where("day(date) >= 10") if late else a.where("day(date) <= 20")
    text = F.when(F.dayofmonth("date") % 3 == 0, "").otherwise(F.concat(F.lit("late " if late else "early "), F.col("date").cast("string")))
    return some.groupBy("date").agg(F.count(F.lit(1)).alias("total_activities")).withColumn("summary", text)


@query(
    "daily_upsert",
    """with o as (select date, count(*) as total_activities, case when day(date) % 3 = 0 then '' else 'early ' || date end as summary from activities where day(date) <= 20 group by 1),
    n as (select date, count(*) as total_activities, case when day(date) % 3 = 0 then '' else 'late ' || date end as summary from activities where day(date) >= 10 group by 1)
    select coalesce(n.date, o.date) as date, case when n.date is not null then n.total_activities else o.total_activities end as total_activities, coalesce(nullif(n.summary, ''), o.summary) as summary from o full join n on n.date = o.date""", days=('date',))
def _(spark, d):
    return maintain.upsert(_daily(spark, d, late=False), _daily(spark, d, late=True), "date", ["summary"])


@query("retention_delete", "select id, date from activities where date >= date '2024-01-20' - 7", days=('date',))
def _(spark, d):
    return maintain.retain(activities(spark, d), "2024-01-20", 7).select("id", "date")


@query("cascade_delete", f"select activity_id, repo_name from dev_contexts where activity_id in (select id from activities where date <> '{DAY}')")
def _(spark, d):
    left = maintain.delete(activities(spark, d), F.col("date") == F.lit(DAY).cast("date"))
    return maintain.cascade(dev_contexts(spark, d), left).select("activity_id", "repo_name")


@query(
    "status_backfill",
    """with t as (select event_id as id, event_id % 3 <> 0 as analyzed, case when event_id % 5 = 0 then null else value end as confidence,
        case event_id % 7 when 0 then 'skipped (CORRUPT screenshot)' when 1 then 'Skipped (screenshot deleted)' when 2 then 'Skipped (analysis backlog)' when 3 then 'Analysis failed: x' when 4 then null else 'Working' end as summary,
        case when event_id % 2 = 0 then 'pending' else 'ok' end as status from events)
    select id, case when status <> 'pending' then status when analyzed and (summary ilike 'Skipped (corrupt%' or summary ilike 'Skipped (screenshot deleted%') then 'dead' when analyzed and confidence is null then 'dead'
        when analyzed and summary = 'Skipped (analysis backlog)' then 'skipped' when analyzed and summary ilike 'Analysis failed%' then 'failed' when analyzed then 'ok' else 'pending' end as status from t""",
)
def _(spark, d):
    i = F.col("event_id")
    said = F.when(i % 7 == 0, "skipped (CORRUPT screenshot)").when(i % 7 == 1, "Skipped (screenshot deleted)").when(i % 7 == 2, "Skipped (analysis backlog)").when(i % 7 == 3, "Analysis failed: x").when(i % 7 == 4, None).otherwise("Working")
    rows = read(spark, d, "events").select(i.alias("id"), (i % 3 != 0).alias("analyzed"), F.when(i % 5 != 0, F.col("value")).alias("confidence"), said.alias("summary"), F.when(i % 2 == 0, "pending").otherwise("ok").alias("status"))
    return maintain.backfill_status(rows).select("id", "status")


@query(
    "stale_meetings",
    f"select id, coalesce(end_time, start_time) as end_time, case when end_time is null then 0.0 else duration_minutes end::double as duration_minutes, case when end_time is null then case when trim(transcript) not in ('', '(No speech detected)') then '{maintain.INTERRUPTED}' else '{maintain.UNEXPECTED}' end else summary end as summary from meetings",
)
def _(spark, d):
    return maintain.close_meetings(meetings(spark, d)).select("id", "end_time", "duration_minutes", "summary")


# --------------------------------------------------------- reports and routing

_ENTRIES = """e0 as (select *, trim(case when id % 2 = 0 then ocr_text else '' end) as o, row_number() over (partition by date order by timestamp desc, id desc) as place from activities where status = 'ok'),
    e1 as (select *, count(*) filter (where o <> '') over (partition by date order by timestamp desc, id desc rows unbounded preceding) as seen from e0 where place <= 150),
    en as (select date, place::integer as place, '[' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') || '] ' || app_name || ' (' || category || '): ' || coalesce(summary, '') ||
        case when o <> '' and seen <= 20 then chr(10) || '  Screen content: ' || case when length(o) > 300 then substr(o, 1, 300) || '...' else o end else '' end as entry from e1)"""


def _entries(spark, d):
    a = activities(spark, d, "text")
    return context.entries(a.withColumn("organized_text", F.when(F.col("id") % 2 == 0, F.col("ocr_text")).otherwise("")))


@query("quota_context", f"with {_ENTRIES} select * from en", days=('date',))
def _(spark, d):
    return _entries(spark, d)


@query(
    "standup_notes",
    """with s0 as (select *, trim(case when value > 50 then ocr_text else '' end) as o, row_number() over (partition by date order by timestamp desc, id desc) as place from activities where status = 'ok'),
    s1 as (select *, count(*) filter (where o <> '') over (partition by date order by place rows unbounded preceding) as seen from s0 where place <= 150),
    s2 as (select date, place, '- ' || app_name || ': ' || coalesce(summary, '') || case when o <> '' and seen <= 15 then chr(10) || '  Content: ' || case when length(o) > 200 then substr(o, 1, 200) || '...' else o end else '' end as entry from s1),
    s3 as (select *, sum(length(entry) + 1) over (partition by date order by place rows unbounded preceding) as used from s2)
    select date, string_agg(entry, chr(10) order by place) as text from s3 where used <= 7866 group by 1""",
    days=("date",),
)
def _(spark, d):
    a = activities(spark, d, "text")
    return context.standup(a.withColumn("organized_text", F.when(F.col("value") > 50, F.col("ocr_text")).otherwise("")), 4096)


@query("budget_context", f"with {_ENTRIES}, u as (select *, sum(length(entry) + 1) over (partition by date order by place rows unbounded preceding) as used from en) select date, string_agg(entry, chr(10) order by place) as text from u where used <= 6000 group by 1", days=('date',))
def _(spark, d):
    return context.report(context.within_budget(_entries(spark, d), 6000))


_HOOKS = [("all", True, "", "http://a/x, http://b/y", "s"), ("marks", True, "bookmark,agent_output", "http://c/z", ""), ("off", False, "", "http://d", ""), ("none", True, "test", " , ", "")]
_HOOK_SQL = "h(name, url, event) as (values ('all', 'http://a/x', null), ('all', 'http://b/y', null), ('marks', 'http://c/z', 'bookmark'), ('marks', 'http://c/z', 'agent_output'))"
_EVENT_SQL = "ev as (select event_id as id, case event_type when 'click' then 'bookmark' when 'view' then 'daily_summary' when 'purchase' then 'agent_output' else 'test' end as event from events)"


def _events(spark, d):
    kind = F.col("event_type")
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.when(kind == "click", "bookmark").when(kind == "view", "daily_summary").when(kind == "purchase", "agent_output").otherwise("test").alias("event"))


@query("webhook_routes", f"with {_HOOK_SQL}, {_EVENT_SQL} select id, ev.event, name, url from ev join h on h.event is null or h.event = ev.event")
def _(spark, d):
    return context.route(_events(spark, d), spark.createDataFrame(_HOOKS, "name string, enabled boolean, events string, urls string, secret string"))


@query("latest_agent_run", "with l as (select app_name as agent, arg_max(row(timestamp, status), row(timestamp, id)) as l from activities group by 1), a as (select distinct 'app_' || (user_id % 20) as name from events) select name, l[1] as last_run, l[2] as last_status from a left join l on l.agent = a.name")
def _(spark, d):
    agents = read(spark, d, "events").select(F.concat(F.lit("app_"), (F.col("user_id") % 20).cast("string")).alias("name")).distinct()
    return context.with_latest_run(agents, activities(spark, d).withColumnRenamed("app_name", "agent"))


@query("delivery_log", f"with {_EVENT_SQL} select id, event from ev order by id desc limit 50")
def _(spark, d):
    return _events(spark, d).orderBy(F.col("id").desc()).limit(50)


# -------------------------------------------------------------------- sequence


@query(
    "frame_dedup",
    """with recursive o as (select user_id, event_id as id, round(value * 100)::bigint as h, row_number() over (partition by user_id order by ts, event_id) as rn from events),
    f as (select user_id, id, rn, h as last, true as kept from o where rn = 1
      union all select o.user_id, o.id, o.rn, case when bit_count(xor(f.last, o.h)) > 4 then o.h else f.last end, bit_count(xor(f.last, o.h)) > 4 from f join o on o.user_id = f.user_id and o.rn = f.rn + 1)
    select user_id, id from f where kept""",
)
def _(spark, d):
    rows = activities(spark, d).select("user_id", "id", "timestamp", F.round(F.col("value") * 100).cast("bigint").alias("h"))
    return folds.frame_dedup(rows, threshold=4)


_STEP = "row_number() over (partition by {by} order by timestamp, id) as rn"


@query(
    "usage_alerts",
    f"""with recursive o as (select user_id, id, epoch_us(timestamp) / 1e6::double as now, case when id % 3 = 0 then 'youtube' else 'editor' end as app, category, {_STEP.format(by='user_id')} from activities),
    f as (
      select user_id, id, rn, now, app, now as since, now as work, null::double as td, null::double as tb, null::double as tf, false as d, false as b, false as c, 0::double as mins, 0::double as worked from o where rn = 1
      union all
      select user_id, id, rn, now, app, since, case when worked >= 90 then now else work end, case when d then now else td end, case when b then now else tb end, case when c then now else tf end, d, b, c, mins, worked from (
        select *, app = 'youtube' and mins >= 45 and coalesce(now - td, 1e18) >= 1800 as d, worked >= 90 and coalesce(now - tb, 1e18) >= 1800 as b, category = 'coding' and mins >= 120 and coalesce(now - tf, 1e18) >= 1800 as c from (
          select *, (now - since) / 60 as mins, (now - work) / 60 as worked from (
            select o.user_id, o.id, o.rn, o.now, o.app, o.category, case when o.app <> f.app then o.now else f.since end as since, case when o.app <> f.app and o.now - f.work > 5400 then o.now else f.work end as work, f.td, f.tb, f.tf
            from f join o on o.user_id = f.user_id and o.rn = f.rn + 1))))
    select user_id, id, 'distraction' as kind, trunc(mins)::integer as minutes from f where d union all select user_id, id, 'break', trunc(worked)::integer from f where b union all select user_id, id, 'focus', trunc(mins)::integer from f where c""",
)
def _(spark, d):
    rows = activities(spark, d).select("user_id", "timestamp", "id", F.when(F.col("id") % 3 == 0, "YouTube").otherwise("Editor").alias("app_name"), "category")
    return folds.per_key(rows, folds.alert_kernel, "user_id", ["id", "seconds", "app_name", "category"], "user_id long, id long, kind string, minutes int")


@query(
    "cache_tiers",
    f"""with recursive o as (select *, {_STEP.format(by='app_name, title')} from (select case when user_id % 12 = 0 then 'Slack' else app_name end as app_name, 'title ' || (user_id % 7) as title, id, timestamp, epoch_us(timestamp) / 1e6::double as now, (round(value * 100)::bigint // 64) as h, bookmarked from activities)),
    f as (
      select app_name, title, id, rn, h, now as since, 'full' as tier from o where rn = 1
      union all
      select app_name, title, id, rn, case when tier = 'identical' then eh else h end, case when tier = 'full' then now else since end, tier from (
        select *, case when bookmarked then 'full' when bit_count(xor(eh, h)) <= 3 then 'identical' when bit_count(xor(eh, h)) <= 10 and now - since < (case when app_name = 'Slack' then 240 else 420 end) then 'minor' else 'full' end as tier from (
          select o.app_name, o.title, o.id, o.rn, o.h, o.now, o.bookmarked, f.h as eh, f.since from f join o on o.app_name = f.app_name and o.title = f.title and o.rn = f.rn + 1)))
    select app_name, title, id, tier from f""",
)
def _(spark, d):
    app = F.when(F.col("user_id") % 12 == 0, "Slack").otherwise(F.col("app_name"))
    rows = activities(spark, d).select(app.alias("app_name"), F.concat(F.lit("title "), (F.col("user_id") % 7).cast("string")).alias("title"), "timestamp", "id", F.floor(F.round(F.col("value") * 100) / 64).cast("bigint").alias("h"), "bookmarked")
    return folds.per_key(rows, folds.title_tiers, ["app_name", "title"], ["id", "seconds", "h", "bookmarked", "app_name"], "app_name string, title string, id long, tier string")


@query(
    "screen_looks",
    f"""with recursive o as (select user_id, epoch_us(timestamp) / 1e6::double as now, value > 60 as changed, {_STEP.format(by='user_id')} from activities),
    f as (
      select user_id, rn, now, now as saved, 0 as skips, true as looked, true as keep from o where rn = 1
      union all
      select user_id, rn, now, case when looked and changed then now else saved end, case when not looked then skips when changed then 0 else skips + 1 end, looked, looked and changed from (
        select *, now - saved >= (case when skips >= 3 then 90000 else 20000 end) as looked from (
          select o.user_id, o.rn, o.now, o.changed, f.saved, f.skips from f join o on o.user_id = f.user_id and o.rn = f.rn + 1)))
    select user_id, round(now)::bigint as second, keep from f where looked""",
)
def _(spark, d):
    """Looks at a screen per user; a journal of days instead of seconds, so the waits are longer."""
    rows = activities(spark, d).select("user_id", "timestamp", "id", (F.col("value") > 60).alias("changed"))
    looks = folds.per_key(rows, _slow_looks, "user_id", ["seconds", "changed"], "user_id long, now double, keep boolean")
    return looks.select("user_id", F.round("now").cast("long").alias("second"), "keep")


def _slow_looks(state, rows):
    return folds.look_kernel(state, rows, interval=90_000, change=20_000)


@query(
    "voice_meetings",
    f"""with recursive o as (select user_id, epoch_us(timestamp) / 1e6::double as now, id % 2 = 0 as voice, id % 5 <> 0 as front, id % 7 <> 0 as alive, {_STEP.format(by='user_id')} from activities),
    f as (
      select user_id, rn, now, null::double as st, case when voice and front then now end as pr, 0 as quiet, null::double as lft, null::double as ended from o where rn = 1
      union all
      select user_id, rn, now, case when over then null when began then pr when st is not null then st end, case when st is not null then case when over then null else pr end when voice and front then case when began then null else now end else pr end,
        case when over or began then 0 else q end, case when over or began then null else l end, case when over then st end from (
        select *, st is not null and (q >= 3 or coalesce(now - l, 0) >= 90000 or (coalesce(now - l, 0) > 30000 and not alive)) as over, st is null and voice and front and pr is not null and now - pr <= 40000 as began from (
          select o.user_id, o.rn, o.now, o.voice, o.front, o.alive, f.st, f.pr, case when f.st is null then f.quiet when not o.front then f.quiet when o.voice then 0 else f.quiet + 1 end as q, case when f.st is null then f.lft when o.front then null when f.lft is null then o.now else f.lft end as l
          from f join o on o.user_id = f.user_id and o.rn = f.rn + 1)))
    select user_id, round(ended)::bigint as started, round(now)::bigint as ended from f where ended is not null""",
)
def _(spark, d):
    """Meetings out of voice probes per user; waits as long as the journal's gaps ask for."""
    i = F.col("id")
    rows = activities(spark, d).select("user_id", "timestamp", "id", (i % 2 == 0).alias("voice"), (i % 5 != 0).alias("front"), (i % 7 != 0).alias("alive"))
    found = folds.per_key(rows, _slow_meetings, "user_id", ["seconds", "voice", "front", "alive"], "user_id long, a double, b double")
    return found.select("user_id", F.round("a").cast("long").alias("started"), F.round("b").cast("long").alias("ended"))


def _slow_meetings(state, rows):
    return folds.meeting_kernel(state, rows, confirm=40_000, away=90_000, gone=30_000)


@query(
    "meeting_sessions",
    """with c as (select *, coalesce((epoch_us(timestamp) - epoch_us(lag(timestamp) over (partition by app_name order by timestamp, id)) >= 300000000)::integer, 1) as c from activities),
    r as (select *, sum(c) over (partition by app_name order by timestamp, id) as s from c)
    select app_name, min(timestamp) as start_time, max(timestamp) + interval 300 second as end_time, count(*) as n from r group by app_name, s""",
)
def _(spark, d):
    a = activities(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    w = F.session_window("timestamp", "300 seconds")
    out = a.groupBy(w.alias("w"), "app_name").agg(F.count(F.lit(1)).alias("n"))
    return out.select("app_name", F.col("w.start").cast("timestamp_ntz").alias("start_time"), F.col("w.end").cast("timestamp_ntz").alias("end_time"), "n")


@query("tumbling_counts", "select date_trunc('hour', timestamp) as start, date_trunc('hour', timestamp) + interval 1 hour as \"end\", category, count(*) as n from activities group by all")
def _(spark, d):
    from daybook.streaming.streams import tumbling

    a = activities(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return tumbling(a).withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query(
    "sliding_counts",
    """select w as start, w + interval 1 hour as "end", category, count(*) as n
    from (select category, unnest(list_transform(range(0, 4), lambda k: time_bucket(interval 15 minutes, timestamp) - to_minutes((15 * k)::int))) as w, timestamp from activities)
    where timestamp < w + interval 1 hour group by all""",
)
def _(spark, d):
    from daybook.streaming.streams import tumbling

    a = tumbling(activities(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp")), "1 hour", "15 minutes")
    return a.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query(
    "session_counts",
    """with g as (select app_name, timestamp, coalesce(timestamp > lag(timestamp) over w + interval 20 minutes, true)::int as opens from activities window w as (partition by app_name order by timestamp)),
    s as (select app_name, timestamp, sum(opens) over (partition by app_name order by timestamp) as k from g)
    select app_name, min(timestamp) as start, max(timestamp) + interval 20 minutes as "end", count(*) as n from s group by app_name, k""",
)
def _(spark, d):
    from daybook.streaming.streams import sessions

    a = sessions(activities(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp")), "20 minutes")
    return a.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("deduplicated_rows", "select id, user_id, category from (select *, row_number() over (partition by user_id, category, date_trunc('hour', timestamp) order by timestamp, id) as k from activities) where k = 1")
def _(spark, d):
    from daybook.streaming.streams import deduplicated

    a = activities(spark, d).withColumn("hour", F.date_trunc("hour", F.col("timestamp").cast("timestamp")))
    return deduplicated(a, ["user_id", "category", "hour"]).select("id", "user_id", "category")


@query(
    "known_categories",
    """select page_id, case page_id % 6 when 0 then 'terminal' when 1 then 'communication' when 2 then 'writing' when 3 then 'communication' else 'terminal' end as category from pages""",
)
def _(spark, d):
    from daybook.functions.titles import known_category

    i = F.col("page_id") % 6
    app = F.when(i == 0, "gnome-terminal-").when(i == 1, "Microsoft Teams").when(i == 2, "AnyType 0.38").when(i == 3, "thunderbir").when(i == 4, "steam").otherwise("Windows cmd")
    return read(spark, d, "pages").select("page_id", known_category(app).alias("category"))


@query("agent_payload", None, days=("date",))
def _(spark, d):
    from daybook.operators.payload import day_payload

    return day_payload(activities(spark, d, "url", "text"), meetings(spark, d), newest=None)


@query("organized_boxes", r"select doc_id, '[MAIN CONTENT]' || chr(10) || s as text from (select doc_id, regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g') as s from documents) where length(s) > 1")
def _(spark, d):
    """A screen of one box that holds a whole text."""
    from daybook.functions.layout import column_regions, organised_text

    said = F.regexp_replace(F.replace("text", F.lit("\n"), F.lit(" ")), r"^\s+|\s+$", "")
    point = lambda x, y: F.array(F.lit(x), F.lit(y))
    box = F.struct(F.array(point(900, 10), point(980, 10), point(980, 30), point(900, 30)).alias("box"), said.alias("text"), F.lit(0.9).alias("conf"))
    rows = read(spark, d, "documents").where(F.length(said) > 1).select("doc_id", F.array(box).alias("boxes"))
    return rows.select("doc_id", organised_text(F.col("boxes"), column_regions(F.col("boxes"), F.lit(1920)), F.lit(1920), F.lit(1080)).alias("text"))


#: Boxes (id, place, x, y, text, conf) of DuckDB in reading order: regions (id, r, name, x0, x1, y0, y1, kind) take
#: them, rows open where a box lies more than 25 below the first of its row, senders stand left of a timestamp.
_PLACE_BOXES = r"""
    homes as (
        select b.*, (select arg_min(r.name, ((r.x1 - r.x0) * (r.y1 - r.y0), r.r)) from regions r
            where r.id = b.id and b.cx between r.x0 and r.x1 and b.cy between r.y0 and r.y1) as home
        from boxes b where length(text) > 1 and conf >= 0.3
    ), placed as (
        select *, regexp_matches(text, '\d{2}[-./]\d{2}[-./]\d{2,4}') as stamped, row_number() over (partition by id, home order by y, x, place) as k from homes
    )"""
_READ_SCREENS = r"""
    senders as (
        select t.id, t.home, arg_max(b.k, (b.x, -b.y, -b.place)) as k from placed t join placed b
            on b.id = t.id and b.home = t.home and t.stamped and not b.stamped and b.x < t.x and b.y > t.y - 15 and b.y < t.y + 15
        group by t.id, t.home, t.k
    ), said as (
        select p.*, p.k in (select s.k from senders s where s.id = p.id and s.home = p.home) as names from placed p
    ), turns as (
        select *, sum(names::int) over (partition by id, home order by k) as turn from said
    ), spoken as (
        select id, home, turn, max(text) filter (where names) || ': ' || string_agg(text, ' | ' order by k) filter (where not names and not stamped) as line
        from turns where turn > 0 group by all
    ), chats as (
        select id, home, string_agg(line, chr(10) order by turn) as chat from spoken group by all
    ), rows_of as (
        select id, home, line, string_agg(text, '  ' order by x, k) as text from lines group by all
    ), flat as (
        select id, home, string_agg(text, chr(10) order by line) as flat from rows_of group by all
    ), marked as (select id, home, bool_or(stamped) as stamped from placed group by all),
    sections as (
        select f.id, coalesce(r.r, 99) as r, '[' || coalesce(upper(replace(r.name, '_', ' ')), 'OTHER') || ']' || chr(10)
            || case when r.kind in ('messages', 'chat') or contains(r.name, 'chat') or contains(r.name, 'message') or (m.stamped and r.kind in ('content', 'unknown', 'navigation')) then coalesce(c.chat, f.flat) else f.flat end as text
        from flat f join marked m on m.id = f.id and m.home is not distinct from f.home
            left join chats c on c.id = f.id and c.home = f.home left join regions r on r.id = f.id and r.name = f.home
    )"""


@query(
    "organized_screens",
    rf"""with w as (select doc_id as id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from documents),
    u as (select id, unnest(w) as text, unnest(range(0, len(w))) as i, len(w) as n from w where len(w) > 0),
    b as (
        select id, n, n - 1 - i + 2 as place, (case i % 3 when 0 then 100 when 1 then 900 else 1600 end + 70 * (1 - (i // 3) % 2))::int as x, (40 * (i // 6) + 5 * ((i // 3) % 2))::int as y, text, 0.9 as conf from u
        union all select distinct id, n, 0, 900, 10, 'doubtful', 0.29 from u
        union all select distinct id, n, 1, 1750, 0, '12.03.24', 0.9 from u where id % 2 = 0
    ), boxes as materialized (select *, (x + x + 60) / 2.0::double / 1920 as cx, (y + y + 20) / 2.0::double / (40 * n + 60) as cy from b),
    sides as (select id, count(*) filter (where cx < 0.22) as l, count(*) filter (where cx > 0.78) as r, count(*) as n from boxes group by all),
    regions as materialized (
        select id, 1 as r, 'region_left' as name, 0.0 as x0, 0.22 as x1, 0.0 as y0, 1.0 as y1, 'navigation' as kind from sides where l >= 2
        union all select id, 2, 'region_center', case when l >= 2 then 0.22 else 0.0 end, case when r >= 2 then 0.78 else 1.0 end, 0.0, 1.0, 'content' from sides where n - l - r >= 2
        union all select id, 3, 'region_right', 0.78, 1.0, 0.0, 1.0, 'content' from sides where r >= 2
        union all select id, 4, 'main_content', 0.0, 1.0, 0.0, 1.0, 'content' from sides where l < 2 and r < 2 and n - l - r < 2
    ),
    {_PLACE_BOXES},
    lines as (select *, sum(opens) over (partition by id, home order by k) as line from (select *, coalesce(y - lag(y) over (partition by id, home order by k) > 25, true)::int as opens from placed)),
    {_READ_SCREENS}
    select id as doc_id, coalesce((select string_agg(s.text, chr(10) || chr(10) order by s.r) from sections s where s.id = i.id), '') as text from (select distinct id from u) i""",
)
def _(spark, d):
    """Every word of every text as a box: three columns, two boxes a row, the
    right one a chat for even ids; doubtful boxes between, and all in reverse."""
    from daybook.functions.layout import column_regions, organised_text

    def box(x, y, said, conf):
        x, y = x.cast("int"), y.cast("int")
        point = lambda a, b: F.array(a, b)
        return F.struct(F.array(point(x, y), point(x + 60, y), point(x + 60, y + 20), point(x, y + 20)).alias("box"), said.alias("text"), F.lit(conf).alias("conf"))

    def placed(word, i):
        k = F.floor(i / 3)
        x = F.when(i % 3 == 0, 100).when(i % 3 == 1, 900).otherwise(1600) + 70 * (1 - k % 2)
        return box(x, 40 * F.floor(k / 2) + 5 * (k % 2), word, 0.9)

    words = F.filter(F.split("text", "[ \t\n\x0B\f\r]+"), lambda w: w != "")
    rows = read(spark, d, "documents").select("doc_id", words.alias("words")).where(F.size("words") > 0)
    stamp = F.when(F.col("doc_id") % 2 == 0, F.array(box(F.lit(1750), F.lit(0), F.lit("12.03.24"), 0.9))).otherwise(F.array().cast("array<struct<box:array<array<int>>,text:string,conf:double>>"))
    doubtful = F.array(box(F.lit(900), F.lit(10), F.lit("doubtful"), 0.29))
    boxes = F.reverse(F.concat(F.transform("words", placed), stamp, doubtful))
    rows = rows.select("doc_id", boxes.alias("boxes"), (40 * F.size("words") + 60).alias("height"))
    return rows.select("doc_id", organised_text(F.col("boxes"), column_regions(F.col("boxes"), F.lit(1920)), F.lit(1920), F.col("height")).alias("text"))


@query(
    "screen_texts",
    rf"""with recursive b as (
        select conv_id as id, turn as place, ((turn * 331 + length(text) * 7) % 1700)::int as x, ((turn * 17 + length(text)) % 1000)::int as y,
            case when turn % 3 = 1 then '02-12-2024 20:02' else regexp_replace(substr(text, 1, 12), '^\s+|\s+$', '', 'g') end as text, case when length(text) % 7 = 0 then 0.2 else 0.8 end as conf
        from conversations
    ), boxes as materialized (select *, (x + x + 60) / 2.0::double / 1920 as cx, (y + y + 20) / 2.0::double / 1080 as cy from b),
    ids as (select distinct id from b),
    regions as materialized (select id, r, name, x0, x1, y0, y1, kind from ids, (values (1, 'main', 0.0, 1.0, 0.0, 1.0, 'table'), (2, 'team_chat', 0.0, 0.6, 0.2, 0.9, 'content'), (3, 'top_bar', 0.0, 0.9, 0.0, 0.3, 'navigation')) v(r, name, x0, x1, y0, y1, kind)),
    {_PLACE_BOXES},
    tops as (
        select id, home, k, y, y as top, 1 as line from placed where k = 1
        union all select p.id, p.home, p.k, p.y, case when p.y - t.top > 25 then p.y else t.top end, t.line + (p.y - t.top > 25)::int
        from tops t join placed p on p.id = t.id and p.home is not distinct from t.home and p.k = t.k + 1
    ),
    lines as (select p.*, t.line from placed p join tops t on t.id = p.id and t.home is not distinct from p.home and t.k = p.k),
    {_READ_SCREENS}
    select id as conv_id, coalesce((select string_agg(s.text, chr(10) || chr(10) order by s.r) from sections s where s.id = i.id), '') as text from ids i""",
)
def _(spark, d):
    """Turns of a conversation as boxes strewn over a screen of three regions that
    overlap; every third one is a timestamp."""
    from daybook.functions.layout import organised_text
    from daybook.functions.text import strip

    n = F.length("text")
    x, y = ((F.col("turn") * 331 + n * 7) % 1700).cast("int"), ((F.col("turn") * 17 + n) % 1000).cast("int")
    point = lambda a, b: F.array(a, b)
    said = F.when(F.col("turn") % 3 == 1, "02-12-2024 20:02").otherwise(strip(F.substring("text", 1, 12)))
    box = F.struct(F.array(point(x, y), point(x + 60, y), point(x + 60, y + 20), point(x, y + 20)).alias("box"), said.alias("text"), F.when(n % 7 == 0, 0.2).otherwise(0.8).alias("conf"))
    screens = read(spark, d, "conversations").select("conv_id", F.struct("turn", box.alias("b")).alias("t")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["b"]).alias("boxes"))
    part = lambda name, x0, x1, y0, y1, kind: F.struct(F.lit(name).alias("name"), F.lit(x0).alias("x_start"), F.lit(x1).alias("x_end"), F.lit(y0).alias("y_start"), F.lit(y1).alias("y_end"), F.lit(kind).alias("content_type"))
    regions = F.array(part("main", 0.0, 1.0, 0.0, 1.0, "table"), part("team_chat", 0.0, 0.6, 0.2, 0.9, "content"), part("top_bar", 0.0, 0.9, 0.0, 0.3, "navigation"))
    return screens.select("conv_id", organised_text(F.col("boxes"), regions, F.lit(1920), F.lit(1080)).alias("text"))
