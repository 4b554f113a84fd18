"""Queries over titles, answers, boxes and notes that are made out of the stored
tables, for functions whose own inputs (screens, models, microphones) no table holds."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from daybook.functions import layout, modeltext, titles
from daybook.functions import text as T
from daybook.operators import context, maintain, stats
from daybook.operators.tools import Tools
from daybook.plans.catalogue import _EVENT_SQL, _HOOK_SQL, _HOOKS, _events, _index, _vector, query
from daybook.schema import CATEGORIES, MOODS
from daybook.sources.tables import activities, dev_contexts, meetings, read


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# -------------------------------------------------------------------- lookups


@query("meeting_lookup", "select id, start_time, app_name, duration_minutes, transcript from meetings where id = 5")
def _(spark, d):
    return meetings(spark, d).where("id = 5").select("id", "start_time", "app_name", "duration_minutes", "transcript")


@query(
    "daily_summary_lookup",
    """with c as (select date, count(*) filter (where category = 'coding') as coding, count(*) filter (where category = 'media') as media from activities group by 1)
    select date, case when day(date) % 4 <> 0 then coding end::integer as coding, case when day(date) % 4 <> 0 then media end::integer as media, case when day(date) % 4 <> 0 then 2 else 0 end::integer as kinds from c""", days=("date",))
def _(spark, d):
    """Counts stored as JSON text, read back; every fourth day has none."""
    c = activities(spark, d).groupBy("date").agg(F.count_if(F.col("category") == "coding").alias("coding"), F.count_if(F.col("category") == "media").alias("media"))
    stored = c.select("date", F.when(F.dayofmonth("date") % 4 != 0, F.to_json(F.struct("coding", "media"))).alias("category_breakdown"))
    found = stored.select("date", T.decode_counts(F.col("category_breakdown")).alias("m"))
    return found.select("date", F.col("m")["coding"].alias("coding"), F.col("m")["media"].alias("media"), F.size("m").alias("kinds"))


@query("decoded_rows", "select event_id, case event_id % 4 when 0 then 'a|b ' || event_id when 1 then '' when 3 then '' end as snippets, case event_id % 4 when 0 then 2 when 1 then 0 when 3 then 0 end::integer as n from events")
def _(spark, d):
    """Stored arrays: whole, malformed, missing, and without entries."""
    i = F.col("event_id")
    stored = F.when(i % 4 == 0, F.concat(F.lit('["a", "b '), i.cast("string"), F.lit('"]'))).when(i % 4 == 1, '["a", ').when(i % 4 == 3, "[]")
    rows = read(spark, d, "events").select("event_id", T.decode_array(stored).alias("a"))
    return rows.select("event_id", F.array_join("a", "|").alias("snippets"), F.when(F.col("a").isNotNull(), F.size("a")).alias("n"))


@query("vector_blobs", "select vec_id, (len(embedding) * 4)::integer as bytes, embedding[1]::double as first, embedding[-1]::double as last, list_sum(list_transform(embedding, lambda x: x::double)) as total from embeddings")
def _(spark, d):
    """Vectors as blobs of 32-bit floats and back."""
    rows = read(spark, d, "embeddings").select("vec_id", T.encode_vector(F.col("embedding")).alias("blob"))
    v = rows.select("vec_id", F.octet_length("blob").alias("bytes"), T.decode_vector(F.col("blob")).alias("v"))
    return v.select("vec_id", "bytes", F.element_at("v", 1).cast("double").alias("first"), F.element_at("v", -1).cast("double").alias("last"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total"))


# ----------------------------------------------------------------------- sound


@query("sample_levels", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / len(embedding)), 9) as rms, list_max(list_transform(embedding, lambda x: abs(x::double))) as peak from embeddings")
def _(spark, d):
    rms, peak = stats.rms_and_peak(F.col("embedding"))
    return read(spark, d, "embeddings").select("vec_id", F.round(rms, 9).alias("rms"), peak.alias("peak"))


@query("scaled_samples", "with t as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), p as (select *, list_max(list_transform(e, lambda x: abs(x))) as top from t) select vec_id, list_sum(list_transform(e, lambda x: trunc(x * (0.85::double / top) * 32767)::bigint))::bigint as total, list_max(list_transform(e, lambda x: trunc(x * (0.85::double / top) * 32767)::bigint))::bigint as most from p")
def _(spark, d):
    """Samples at 85 % of full range as 16-bit numbers."""
    s = T.to_int16(T.normalised_audio(F.transform("embedding", lambda x: x.cast("double"))))
    rows = read(spark, d, "embeddings").select("vec_id", s.alias("s"))
    return rows.select("vec_id", F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")).alias("total"), F.array_max("s").cast("bigint").alias("most"))


# --------------------------------------------------------------- window titles

_TITLES = """t as (select event_id, user_id, case event_id % 8 when 0 then 'notes ' || user_id || ' - Editor ' || (user_id % 3) when 1 then 'a – b – Paint' when 2 then 'x — main.py' when 3 then 'Calculator' when 4 then '/home/u' || user_id
    when 5 then 'Report ' || user_id || ' - Google Chrome' when 6 then 'untitled ' || user_id else 'mail - y' end as title, case user_id % 5 when 0 then 'chrome' when 1 then 'Code.exe' when 2 then 'java' when 3 then ' Firefox ' end as hint from events)"""


def _titles(spark, d):
    i, user = F.col("event_id"), F.col("user_id").cast("string")
    title = (
        F.when(i % 8 == 0, F.concat(F.lit("notes "), user, F.lit(" - Editor "), (F.col("user_id") % 3).cast("string"))).when(i % 8 == 1, "a – b – Paint").when(i % 8 == 2, "x — main.py").when(i % 8 == 3, "Calculator")
        .when(i % 8 == 4, F.concat(F.lit("/home/u"), user)).when(i % 8 == 5, F.concat(F.lit("Report "), user, F.lit(" - Google Chrome"))).when(i % 8 == 6, F.concat(F.lit("untitled "), user)).otherwise("mail - y")
    )
    u = F.col("user_id") % 5
    hint = F.when(u == 0, "chrome").when(u == 1, "Code.exe").when(u == 2, "java").when(u == 3, " Firefox ")
    return read(spark, d, "events").select("event_id", "user_id", title.alias("title"), hint.alias("hint"))


def _last_part(dash: str) -> str:
    last = f"trim(string_split(title, '{dash}')[-1])"
    return f"case when contains(title, '{dash}') and length({last}) between 2 and 40 and not (contains({last}, '.') and lower(string_split({last}, '.')[-1]) in ('py', 'js', 'ts', 'rs', 'go', 'java', 'c', 'cpp', 'h', 'rb', 'php', 'cs', 'kt', 'swift', 'lua', 'sh', 'bash', 'zsh', 'ps1', 'html', 'css', 'json', 'yaml', 'yml', 'toml', 'xml', 'ini', 'cfg', 'conf', 'txt', 'md', 'log', 'csv', 'pdf', 'doc', 'docx', 'xls', 'xlsx', 'ppt', 'pptx', 'mp4', 'mkv', 'avi', 'mov', 'webm', 'mp3', 'flac', 'wav', 'ogg', 'png', 'jpg', 'jpeg', 'gif', 'svg', 'bmp', 'webp', 'ico')) then {last} end"


_APP_SQL = f"coalesce({_last_part(' - ')}, {_last_part(' – ')}, {_last_part(' — ')})"
_SIMPLE_SQL = "case when trim(title) <> '' and length(trim(title)) <= 25 and not (contains(lower(trim(title)), '/') or contains(lower(trim(title)), '\\') or contains(lower(trim(title)), '@') or contains(lower(trim(title)), ':') or contains(lower(trim(title)), '$') or contains(lower(trim(title)), '#') or contains(lower(trim(title)), '~') or contains(lower(trim(title)), '.txt') or contains(lower(trim(title)), '.py') or contains(lower(trim(title)), '.js') or contains(lower(trim(title)), '.ts') or contains(lower(trim(title)), '.rs') or contains(lower(trim(title)), '.go') or contains(lower(trim(title)), '.html') or contains(lower(trim(title)), '.css') or contains(lower(trim(title)), '.md') or contains(lower(trim(title)), '.json') or contains(lower(trim(title)), '.yaml') or starts_with(lower(trim(title)), 'untitled') or starts_with(lower(trim(title)), 'new ') or starts_with(lower(trim(title)), 'document')) then trim(title) end"


@query("title_apps", f"with {_TITLES} select event_id, {_APP_SQL} as app, {_SIMPLE_SQL} as simple from t")
def _(spark, d):
    return _titles(spark, d).select("event_id", titles.app_from_title(F.col("title")).alias("app"), titles.simple_title(F.col("title")).alias("simple"))


@query("browser_windows", f"with {_TITLES} select event_id, (ends_with(title, '- Google Chrome') or ends_with(title, '- Mozilla Firefox') or ends_with(title, '- Firefox') or ends_with(title, '- Microsoft Edge') or ends_with(title, '- Brave') or ends_with(title, '- Opera') or ends_with(title, '- Safari') or ends_with(title, '- Vivaldi') or ends_with(title, '- Arc') or ends_with(title, '- Chromium') or ends_with(title, '- Zen Browser') or coalesce(lower(trim(hint)) in ('chrome', 'chromium', 'firefox', 'firefox-esr', 'brave', 'opera', 'safari', 'vivaldi', 'arc', 'msedge'), false)) as browser from t")
def _(spark, d):
    return _titles(spark, d).select("event_id", titles.is_browser(F.col("title"), F.col("hint")).alias("browser"))


@query("specific_names", r"with w as (select conv_id, turn, lower(string_split(coalesce(text, ''), ' ')[1]) as name, lower(coalesce(text, '')) as other from conversations) select conv_id, turn, length(other) > length(name) and regexp_matches(other, '\b' || name || '\b') as more from w where regexp_full_match(name, '[a-z]+')")
def _(spark, d):
    """Whether a turn says more than its first word."""
    said = F.lower(F.coalesce("text", F.lit("")))
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.substring_index(said, " ", 1).alias("name"), said.alias("other"))
    return rows.where(F.rlike("name", F.lit("^[a-z]+$"))).select("conv_id", "turn", titles.is_more_specific(F.col("name"), F.col("other")).alias("more"))


def _declared(names, otherwise: str, column: str) -> str:
    return "case " + " ".join(f"when contains(lower({column}), '{n}') then '{n}'" for n in names) + f" else '{otherwise}' end"


@query("declared_names", f"with t as (select event_id, coalesce(event_type, '') || ' and ' || case event_id % 7 when 0 then 'Coding, WRITING' when 1 then 'media' when 2 then 'nothing' when 3 then 'terminal idle' when 4 then 'Learning productive' when 5 then 'distracted' else '' end as said from events) select event_id, {_declared(CATEGORIES, 'other', 'said')} as category, {_declared(MOODS, 'neutral', 'said')} as mood from t")
def _(spark, d):
    i = F.col("event_id") % 7
    said = F.when(i == 0, "Coding, WRITING").when(i == 1, "media").when(i == 2, "nothing").when(i == 3, "terminal idle").when(i == 4, "Learning productive").when(i == 5, "distracted").otherwise("")
    rows = read(spark, d, "events").select("event_id", F.concat(F.coalesce("event_type", F.lit("")), F.lit(" and "), said).alias("said"))
    return rows.select("event_id", titles.category(F.col("said")).alias("category"), titles.mood(F.col("said")).alias("mood"))


@query("coding_windows", f"with {_TITLES} select event_id, (case event_id % 9 when 0 then 'Coding' when 1 then 'terminal' else 'other' end in ('Coding', 'terminal') or coalesce(replace(lower(hint), '.exe', '') in ('code', 'code - insiders', 'devenv', 'idea64', 'pycharm64', 'webstorm64', 'goland64', 'sublime_text', 'atom', 'notepad++', 'windowsterminal', 'cmd', 'powershell', 'pwsh', 'wt', 'mintty', 'git-bash', 'alacritty', 'wezterm'), false) or contains(lower(title), '.py') or contains(lower(title), '.js') or contains(lower(title), '.ts') or contains(lower(title), '.go') or contains(lower(title), '.rs') or contains(lower(title), '.java') or contains(lower(title), '.cpp') or contains(lower(title), '.c') or contains(lower(title), '.html') or contains(lower(title), '.css') or contains(lower(title), '.jsx') or contains(lower(title), '.tsx') or contains(lower(title), '.vue') or contains(lower(title), '.rb') or contains(lower(title), '.php') or contains(lower(title), 'visual studio code') or contains(lower(title), 'vs code') or contains(lower(title), 'pycharm') or contains(lower(title), 'intellij') or contains(lower(title), 'terminal') or contains(lower(title), 'powershell') or contains(lower(title), 'cmd.exe') or contains(lower(title), 'git ') or contains(lower(title), 'npm ') or contains(lower(title), 'pip ') or contains(lower(title), 'python ') or contains(lower(title), 'node ')) as coding from t")
def _(spark, d):
    i = F.col("event_id") % 9
    kind = F.when(i == 0, "Coding").when(i == 1, "terminal").otherwise("other")
    return _titles(spark, d).select("event_id", titles.is_coding(kind, F.col("hint"), F.col("title")).alias("coding"))


@query(
    "reconciled_apps",
    """select event_id, case event_id % 6 when 0 then 'Alacritty' when 1 then 'VS Code' when 2 then 'AnyType' when 3 then 'Google Chrome' when 4 then 'Calculator' else 'Thing' end as app_name,
    case event_id % 6 when 0 then 'terminal' when 1 then 'coding' when 2 then 'writing' when 3 then 'media' when 4 then 'browsing' else 'other' end as category from events""",
)
def _(spark, d):
    """Six kinds of window; what must come out is stated."""
    i = F.col("event_id") % 6
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    app, kind = pick("VS Code", "VS Code", "Unknown", "Chrome", "Thing", "Thing"), pick("coding", "coding", "coding", "Media content", "browsing the web", "nonsense")
    hint, title = pick("Alacritty", "code", "electron", "chrome", "", "java"), pick("user@host: ~", "", "Notes - AnyType", "Song - YouTube - Google Chrome", "Calculator", "/home/x")
    return read(spark, d, "events").select("event_id", titles.reconcile(app, kind, hint, title).alias("r")).select("event_id", "r.app_name", "r.category")


# --------------------------------------------------------------- model answers


@query(
    "model_answers",
    """select event_id, 'app' || user_id as app_name, case when event_id % 8 = 6 then 'other' else 'coding' end as category,
        case event_id % 8 when 5 then 'first' || chr(10) || event_id else 'saw ' || event_id end as summary, (case when event_id % 8 = 6 then 0.3 when event_id % 8 = 3 then 0.0 else 0.75 end)::double as confidence
    from events where event_id % 8 <> 7""",
)
def _(spark, d):
    """Answers that are bare, fenced, after thinking, cut off, with a trailing comma, with a raw line end, as loose fields, and without any."""
    i = F.col("event_id")
    head = F.concat(F.lit('{"app_name": "app'), F.col("user_id").cast("string"), F.lit('", "activity_category": "coding", "activity_summary": "'))
    said = F.when(i % 8 == 5, F.concat(F.lit("first\n"), i.cast("string"))).otherwise(F.concat(F.lit("saw "), i.cast("string")))
    whole = F.concat(head, said, F.lit('", "confidence": 0.75'))
    answer = (
        F.when(i % 8 == 0, F.concat(whole, F.lit("}")))
        .when(i % 8 == 1, F.concat(F.lit("Here:\n```json\n"), whole, F.lit("}\n```\nDone {x}")))
        .when(i % 8 == 2, F.concat(F.lit("<think>{maybe}</think>"), whole, F.lit(', "seen": ["a", {"b": [1]}]}')))
        .when(i % 8 == 3, F.concat(head, said))
        .when(i % 8 == 4, F.concat(whole, F.lit(", }")))
        .when(i % 8 == 5, F.concat(whole, F.lit(', "visible": ["a", "b')))
        .when(i % 8 == 6, F.concat(F.lit('app_name = "app'), F.col("user_id").cast("string"), F.lit('", activity_summary: "'), said, F.lit('"')))
        .otherwise("nothing to tell")
    )
    read_once = F.explode(F.array_compact(F.array(modeltext.parsed(modeltext.without_thinking(answer)))))  # not again for each field
    r = read(spark, d, "events").select("event_id", read_once.alias("r"))
    return r.select("event_id", "r.app_name", F.col("r.activity_category").alias("category"), F.col("r.activity_summary").alias("summary"), "r.confidence")


# ------------------------------------------------------------------------ text


@query(
    "casual_questions",
    rf"""with t as (select conv_id, turn, case turn % 4 when 0 then 'Hey!' when 1 then 'hello there' when 2 then 'THANKS ... ' else lower(coalesce(text, '')) end as q from conversations),
    w as (select *, list_distinct(list_filter(regexp_split_to_array(lower(q), '\s+'), lambda x: x <> '')) as words from t)
    select conv_id, turn, regexp_replace(lower(q), '^[?!. ]+|[?!. ]+$', '', 'g') in ('hi', 'hii', 'hey', 'hello', 'sup', 'yo', 'thanks', 'thank', 'bye', 'goodbye', 'how are you', 'what''s up', 'whats up', 'tell me a joke', 'joke', 'funny', 'who are you', 'what are you', 'your name', 'good morning', 'good night', 'good evening') or (len(words) <= 2 and len(list_filter(words, lambda x: x in ('hi', 'hii', 'hey', 'hello', 'sup', 'yo', 'thanks', 'bye'))) > 0) as casual from w""",
)
def _(spark, d):
    turn = F.col("turn") % 4
    q = F.when(turn == 0, "Hey!").when(turn == 1, "hello there").when(turn == 2, "THANKS ... ").otherwise(F.lower(F.coalesce("text", F.lit(""))))
    return read(spark, d, "conversations").select("conv_id", "turn", T.is_casual(q).alias("casual"))


_MARKED = "contains(low, 'minimize')::int + contains(low, 'maximize')::int + contains(low, 'restore')::int + contains(low, 'close')::int + contains(low, 'tab bar')::int + contains(low, 'app bar')::int + contains(low, 'address and search bar')::int + contains(low, 'has access to this site')::int + contains(low, 'no access needed')::int + contains(low, 'memory usage')::int + contains(low, 'sleeping')::int + contains(low, 'extensions')::int"


@query("content_texts", f"""with t as (select doc_id, case when lang = 'de' then 'Restore Tab Bar Extensions ' when lang = 'fr' then 'Close, sleeping: ' else '' end || coalesce(text, '') || '   ' as s from documents),
    u as (select doc_id, s, lower(s) as low from t) select doc_id, length(regexp_replace(s, '^\\s+|\\s+$', '', 'g')) > 100 and {_MARKED} < 3 as content from u""")
def _(spark, d):
    """Texts behind three signs of window chrome, two, or none."""
    chrome = F.when(F.col("lang") == "de", "Restore Tab Bar Extensions ").when(F.col("lang") == "fr", "Close, sleeping: ").otherwise("")
    return read(spark, d, "documents").select("doc_id", T.is_content(F.concat(chrome, F.coalesce("text", F.lit("")), F.lit("   "))).alias("content"))


_TWO_TEXTS = """t as (select doc_id, coalesce(text, '') as s, lang, source from documents),
    u as (select doc_id, case when source in ('src1', 'src2') then null when lang = 'es' then 'Minimize Maximize Memory usage ' || substr(s, 1, 40) else substr(s, 1, 400) end as a,
        case when source in ('src2', 'src4') then null else translate(substr(s, 201, 60), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || chr(10) || substr(s, 301, 300) end as o from t)"""


@query(
    "merged_texts",
    f"""with {_TWO_TEXTS},
    v as (select doc_id, coalesce(a, '') as a, coalesce(o, '') as o, lower(coalesce(a, '')) as low from u),
    w as (select *, length(regexp_replace(a, '^\\s+|\\s+$', '', 'g')) as n, {_MARKED} as marks,
        list_filter(list_transform(string_split(o, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 3 and not contains(low, lower(x))) as extras from v)
    select doc_id,
        case when n > 100 and marks < 3 then case when len(extras) > 0 then a || chr(10) || '--- (from image OCR) ---' || chr(10) || array_to_string(extras, chr(10)) else a end
            when o <> '' and a <> '' then a || chr(10) || '--- (from image OCR) ---' || chr(10) || o when o <> '' then o end as text,
        case when n > 100 and marks < 3 then case when len(extras) > 0 then 'a11y+ocr' else 'a11y' end when o <> '' then case when a <> '' then 'a11y+ocr' else 'ocr' end when n > 20 then 'a11y' else 'none' end as method
    from w""",
)
def _(spark, d):
    """A screen's accessibility text, its chrome or none of it, beside recognised
    text that overlaps with it and says some of it in capitals."""
    s = F.coalesce("text", F.lit(""))
    accessible = F.when(F.col("source").isin("src1", "src2"), None).when(F.col("lang") == "es", F.concat(F.lit("Minimize Maximize Memory usage "), F.substring(s, 1, 40))).otherwise(F.substring(s, 1, 400))
    recognised = F.when(~F.col("source").isin("src2", "src4"), F.concat(F.translate(F.substring(s, 201, 60), ascii_lowercase, ascii_uppercase), F.lit("\n"), F.substring(s, 301, 300)))
    rows = read(spark, d, "documents").select("doc_id", T.merge_screen_texts(accessible, recognised).alias("m"))
    return rows.select("doc_id", "m.text", "m.method")


@query("context_texts", "select doc_id, substr(coalesce(nullif(trim(case when doc_id % 3 = 0 then '  ' when doc_id % 3 = 1 then source end), ''), nullif(trim(text), '')), 1, 3000) as text from documents")
def _(spark, d):
    organised = F.when(F.col("doc_id") % 3 == 0, "  ").when(F.col("doc_id") % 3 == 1, F.col("source"))
    return read(spark, d, "documents").select("doc_id", T.context_text(organised, F.col("text")).alias("text"))


@query("section_names", r"with t as (select doc_id, '[TOP BAR]' || chr(10) || coalesce(text, '') || chr(10) || '[SIDE ' || (doc_id % 3) || ']' || chr(10) || '[TOP BAR]' as s from documents) select doc_id, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ',') as names from (select doc_id, list_filter(list_transform(string_split(s, chr(10)), lambda x: regexp_extract(x, '^\[([A-Z][A-Z0-9 ]*)\]', 1)), lambda x: x <> '') as m from t)")
def _(spark, d):
    said = F.concat(F.lit("[TOP BAR]\n"), F.coalesce("text", F.lit("")), F.lit("\n[SIDE "), (F.col("doc_id") % 3).cast("string"), F.lit("]\n[TOP BAR]"))
    return read(spark, d, "documents").select("doc_id", F.array_join(T.section_hints(said), ",").alias("names"))


@query("change_counts", "select event_id, case when event_id % 3 <> 1 then event_id % 40 else 0 end::integer as insertions, case when event_id % 3 <> 2 then user_id % 30 else 0 end::integer as deletions from events")
def _(spark, d):
    """Summary lines of version control, with either number or both."""
    i = F.col("event_id")
    plus, minus = F.concat((i % 40).cast("string"), F.lit(" insertions(+)")), F.concat((F.col("user_id") % 30).cast("string"), F.lit(" deletions(-)"))
    line = F.concat(F.lit(" 3 files changed, "), F.when(i % 3 == 0, F.concat(plus, F.lit(", "), minus)).when(i % 3 == 1, minus).otherwise(plus))
    ins, dels = T.shortstat(line)
    return read(spark, d, "events").select("event_id", ins.alias("insertions"), dels.alias("deletions"))


@query("changed_files", "with t as (select event_id, list_distinct(list_concat(list_concat(['z' || (event_id % 3) || '.py', 'a.py'], case when event_id % 2 = 0 then ['a.py', 'b.py'] else [] end), list_transform(range(0, 10), lambda k: 'n' || (k + event_id % 2)))) as f from events) select event_id, array_to_string(list_sort(f)[1:15], ' ') as files from t")
def _(spark, d):
    i = F.col("event_id")
    unstaged = F.array(F.concat(F.lit("z"), (i % 3).cast("string"), F.lit(".py")), F.lit("a.py"))
    staged = F.when(i % 2 == 0, F.array(F.lit("a.py"), F.lit("b.py")))
    untracked = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda k: F.concat(F.lit("n"), (k + i % 2).cast("string")))
    return read(spark, d, "events").select("event_id", F.array_join(T.changed_files(unstaged, staged, untracked), " ").alias("files"))


@query("page_blocks", "select doc_id, i::integer - 1 as i, b[i] as block from (select doc_id, b, unnest(range(1, len(b) + 1)) as i from (select doc_id, list_transform(list_filter(list_transform(string_split(replace(coalesce(text, ''), '. ', chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), lambda x: substr(x, 1, 2000)) as b from documents))")
def _(spark, d):
    said = F.replace("text", F.lit(". "), F.lit("\n\n"))
    return read(spark, d, "documents").select("doc_id", F.posexplode(T.blocks(said)).alias("i", "block"))


# ------------------------------------------------------------------ screen boxes

_BOXES = "b as (select event_id, user_id, k, (user_id * 37 + k * 613) % 1800 as x, (event_id * 53 + k * 211) % 1000 as y, case k % 4 when 0 then ' w' || k when 1 then 'q' when 2 then 'Spark ' || event_id else 'rest' end as text, ((event_id + k) % 11) / 10.0::double as conf from events, (select unnest(range(0, 6)) as k))"


def _boxes(spark, d):
    """Six boxes a row, 60 x 20, spread over a screen of 1920 x 1080."""
    i, user = F.col("event_id"), F.col("user_id")

    def box(k):
        x, y = ((user * 37 + k * 613) % 1800).cast("int"), ((i * 53 + k * 211) % 1000).cast("int")
        said = F.when(k % 4 == 0, F.concat(F.lit(" w"), k.cast("string"))).when(k % 4 == 1, "q").when(k % 4 == 2, F.concat(F.lit("Spark "), i.cast("string"))).otherwise("rest")
        return F.struct(F.array(F.array(x, y), F.array(x + 60, y), F.array(x + 60, y + 20), F.array(x, y + 20)).alias("box"), said.alias("text"), (((i + k) % 11) / 10.0).alias("conf"))

    return read(spark, d, "events").select("event_id", F.transform(F.sequence(F.lit(0), F.lit(5)), box).alias("boxes"))


@query("kept_boxes", f"with {_BOXES} select event_id, count(*) filter (where length(trim(text)) > 1 and conf > 0.2)::integer as n, coalesce(string_agg(text, '|' order by k) filter (where length(trim(text)) > 1 and conf > 0.2), '') as texts from b group by 1")
def _(spark, d):
    kept = layout.clean_boxes(F.col("boxes"))
    return _boxes(spark, d).select("event_id", F.size(kept).alias("n"), F.array_join(F.transform(kept, lambda b: b["text"]), "|").alias("texts"))


@query("rescaled_boxes", f"with {_BOXES} select event_id, sum(floor(x / 1.5::double) + floor((x + 60) / 1.5::double))::bigint as xs, sum(floor(y / 1.5::double) + floor((y + 20) / 1.5::double))::bigint as ys from b group by 1")
def _(spark, d):
    scaled = layout.rescale(F.col("boxes"), F.lit(1.5))
    total = lambda k: F.aggregate(scaled, F.lit(0).cast("bigint"), lambda s, b: s + b["box"][0][k].cast("bigint") + b["box"][2][k].cast("bigint"))
    return _boxes(spark, d).select("event_id", total(0).alias("xs"), total(1).alias("ys"))


@query(
    "screen_columns",
    f"""with {_BOXES}, n as (select event_id, count(*) filter (where (x + x + 60) / 2.0::double / 1920 < 0.22) as l, count(*) filter (where (x + x + 60) / 2.0::double / 1920 > 0.78) as r, count(*) as n from b group by 1),
    c as (select *, n - l - r as m from n)
    select event_id, case when l < 2 and m < 2 and r < 2 then 'main_content:0.0-1.0' else concat_ws(' ', case when l >= 2 then 'region_left:0.0-0.22' end,
        case when m >= 2 then 'region_center:' || case when l >= 2 then '0.22' else '0.0' end || '-' || case when r >= 2 then '0.78' else '1.0' end end, case when r >= 2 then 'region_right:0.78-1.0' end) end as regions from c""",
)
def _(spark, d):
    regions = layout.column_regions(F.col("boxes"), F.lit(1920))
    shown = F.transform(regions, lambda r: F.concat(r["name"], F.lit(":"), r["x_start"].cast("string"), F.lit("-"), r["x_end"].cast("string")))
    return _boxes(spark, d).select("event_id", F.array_join(shown, " ").alias("regions"))


@query("region_fractions", "select event_id, (case when user_id % 130 > 1 then (user_id % 130) / 100.0 else user_id % 130 end)::double as x_end, 0.5::double as y_end from events")
def _(spark, d):
    part = F.struct(F.lit("a").alias("name"), F.lit(0.0).alias("x_start"), (F.col("user_id") % 130).cast("double").alias("x_end"), F.lit(0.0).alias("y_start"), F.lit(50.0).alias("y_end"), F.lit("content").alias("content_type"))
    r = read(spark, d, "events").select("event_id", F.get(layout.fractions(F.array(part)), 0).alias("r"))
    return r.select("event_id", "r.x_end", "r.y_end")


@query(
    "region_answers",
    r"""with t as (select doc_id, lang, 1 + length(coalesce(text, '')) % 4 as n, length(coalesce(text, '')) % 3 as more from documents),
    told as (select doc_id, list_transform(range(0, n - case when lang = 'es' then 1 else 0 end), lambda j: concat('r', j, ':', j * 10, '-', j * 10 + 9, ':', case when more = 1 then '5' else '0' end, '-', case when more = 1 then '50' else '1' end, ':', case when more = 2 then 'chat' else 'unknown' end)) as r from t where lang is not null)
    select doc_id, case when len(r) = 0 then 'full_screen:0-1:0-1:unknown' else array_to_string(r, ' ') end as regions from told""",
)
def _(spark, d):
    """A model's answers: one to four regions, in fences, in prose, or broken off within the last one."""
    n, more = F.length(F.coalesce("text", F.lit(""))) % 4 + 1, F.length(F.coalesce("text", F.lit(""))) % 3
    extra = F.when(more == 1, ', "y_start": 5, "y_end": 50').when(more == 2, ', "content_type": "chat"').otherwise("")
    one = lambda j: F.concat(F.lit('{"name": "r'), j.cast("string"), F.lit('", "x_start": '), (j * 10).cast("string"), F.lit(', "x_end": '), (j * 10 + 9).cast("string"), extra, F.lit("}"))
    whole = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), n - 1), one), ", "), F.lit("]"))
    said = F.when(F.col("lang") == "fr", F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(F.col("lang") == "de", F.concat(F.lit("The regions are: "), whole, F.lit(" and no more."))).when(F.col("lang") == "es", F.substring(whole, F.lit(1), F.length(whole) - 8)).otherwise(whole)
    rows = read(spark, d, "documents").where(F.col("lang").isNotNull()).select("doc_id", modeltext.regions_of(said).alias("r"))
    shown = lambda x: F.format_string("%s:%.0f-%.0f:%.0f-%.0f:%s", x["name"], x["x_start"], x["x_end"], x["y_start"], x["y_end"], x["content_type"])
    return rows.select("doc_id", F.array_join(F.transform("r", shown), " ").alias("regions"))


@query("marked_boxes", f"with {_BOXES} select event_id, count(*) filter (where contains(lower(text), 'spark'))::integer as n, coalesce(sum(greatest(x - 4, 0) + greatest(y - 4, 0) + least(x + 64, 1920) + least(y + 24, 1080)) filter (where contains(lower(text), 'spark')), 0)::bigint as total from b group by 1")
def _(spark, d):
    hit = layout.highlights(F.col("boxes"), "to Spark", F.lit(1920), F.lit(1080))
    total = F.aggregate(hit, F.lit(0).cast("bigint"), lambda s, b: s + b["x1"].cast("bigint") + b["y1"].cast("bigint") + b["x2"].cast("bigint") + b["y2"].cast("bigint"))
    return _boxes(spark, d).select("event_id", F.size(hit).alias("n"), total.alias("total"))


@query("stamped_texts", r"select doc_id, regexp_matches(coalesce(text, '') || case when doc_id % 4 = 0 then ' 12.03.24' else '' end, '\d{2}[-./]\d{2}[-./]\d{2,4}') as stamped from documents")
def _(spark, d):
    said = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 4 == 0, " 12.03.24").otherwise(""))
    return read(spark, d, "documents").select("doc_id", layout.is_timestamp(said).alias("stamped"))


# ----------------------------------------------------------------- maintenance


@query("dead_rows", "select id, case when id % 29 = 3 then 'dead' else status end as status from activities")
def _(spark, d):
    a = activities(spark, d).select("id", "status")
    return maintain.mark_dead(a, read(spark, d, "events").where("event_id % 29 = 3").select(F.col("event_id").alias("id")))


@query("agent_states", "select event_id, case when event_id % 3 = 0 then 'a=1' || ' b=' || user_id else 'b=' || user_id end || ' c=new' as state from events")
def _(spark, d):
    """State maps with one key set and one removed."""
    pairs = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    user = F.col("user_id").cast("string")
    old = F.when(F.col("event_id") % 3 == 0, pairs("a", "1", "b", user, "gone", "x")).otherwise(pairs("gone", "x", "b", user, "c", "old"))
    new = maintain.set_state(old, {"c": "new", "gone": None})
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(new), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), " ")
    return read(spark, d, "events").select("event_id", shown.alias("state"))


@query("enabled_lines", "select event_id, '---' || chr(10) || 'name: n' || event_id || chr(10) || 'enabled: false' || chr(10) || 'x: enabled: yes' || chr(10) || '---' as text from events")
def _(spark, d):
    said = F.concat(F.lit("---\nname: n"), F.col("event_id").cast("string"), F.lit("\nenabled: yes"), F.lit("\nx: enabled: yes\n---"))
    return read(spark, d, "events").select("event_id", maintain.set_enabled(said, False).alias("text"))


@query("fresh_rows", "select id from activities where bookmarked or timestamp >= timestamp '2024-01-20 12:00:00' - interval 180 second")
def _(spark, d):
    from daybook.streaming.streams import fresh

    return fresh(activities(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp")), now="2024-01-20 12:00:00").select("id")


_AFTER = "select 'activities' as name, count(*) as n from activities where {a} union all select 'dev_contexts', count(*) from dev_contexts where activity_id in (select id from activities where {a}) union all select 'meetings', count(*) from meetings where {m}"


def _counts(tables):
    out = None
    for name, t in tables.items():
        part = t.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def _tables(spark, d):
    return {"activities": activities(spark, d), "dev_contexts": dev_contexts(spark, d), "meetings": meetings(spark, d)}


@query("deleted_day", _AFTER.format(a="date <> '2024-01-15'", m="start_time::date <> '2024-01-15'"))
def _(spark, d):
    return _counts(maintain.delete_day(_tables(spark, d), "2024-01-15"))


@query("retained_tables", _AFTER.format(a="date >= date '2024-01-20' - 7", m="start_time::date >= date '2024-01-20' - 7"))
def _(spark, d):
    return _counts(maintain.retain_all(_tables(spark, d), "2024-01-20", 7))


# ---------------------------------------------------------------- hooks and notes


@query(
    "hook_deliveries",
    f"""with {_HOOK_SQL}, {_EVENT_SQL}, r as (select id, ev.event, name, url from ev join h on h.event is null or h.event = ev.event),
    t as (select *, unnest([1, 2])::integer as attempt from r), c as (select *, case when attempt = 1 and id % 3 = 0 then 500 when attempt = 1 and id % 11 = 5 then 0 when attempt = 2 and id % 6 = 0 then 404 else 200 end::integer as status_code from t)
    select id, name, url, event, attempt, case when status_code = 200 then 'ok' else 'failed' end as status, status_code from c where attempt = 1 or id % 3 = 0 or id % 11 = 5""",
)
def _(spark, d):
    """Every third event fails at first, some get no answer, and some fail again."""
    routed = context.route(_events(spark, d), spark.createDataFrame(_HOOKS, "name string, enabled boolean, events string, urls string, secret string"))
    i = F.col("id")
    sent = routed.select("id", "url").distinct().withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    code = F.when((F.col("attempt") == 1) & (i % 3 == 0), 500).when((F.col("attempt") == 2) & (i % 6 == 0), 404).otherwise(200)
    answers = sent.where(~((F.col("attempt") == 1) & (i % 11 == 5) & (i % 3 != 0))).withColumn("status_code", code)
    return context.deliveries(routed, answers)


@query(
    "daily_notes",
    """select date, '---' || chr(10) || 'tags: [journal]' || chr(10) || 'date: ' || date || chr(10) || 'activities: ' || n || chr(10) || '---' || chr(10) || chr(10) || '# ' || date || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || coalesce(summary, '')
    || case when standup <> '' then chr(10) || chr(10) || '## Standup' || chr(10) || chr(10) || standup else '' end as text
    from (select date, count(*) as n, case when day(date) % 3 > 0 then 'busy with ' || min(category) end as summary, case when day(date) % 2 = 0 then 'did ' || count(*) else '' end as standup from activities group by 1)""", days=("date",))
def _(spark, d):
    c = activities(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.min("category").alias("least"))
    summary = F.when(F.dayofmonth("date") % 3 > 0, F.concat(F.lit("busy with "), "least"))
    standup = F.when(F.dayofmonth("date") % 2 == 0, F.concat(F.lit("did "), F.col("n").cast("string"))).otherwise("")
    return c.select("date", context.markdown(F.col("date").cast("string"), summary, standup, F.col("n")).alias("text"))


# ------------------------------------------------------------------------ tools


def _tools(spark, d, *extra: str, search: bool = False) -> Tools:
    rows = activities(spark, d, *extra)
    if not search:
        return Tools(rows, dev_contexts(spark, d), meetings(spark, d))
    return Tools(rows, dev_contexts(spark, d), meetings(spark, d), _index(spark, d), lambda _: _vector(spark, d), lambda ids: activities(spark, d, "text", ids=ids))


def _numbers(answered, name: str, fields: str):
    """The rows of an answer, read back out of its JSON."""
    return answered.select(F.posexplode(F.from_json("json", f"struct<count:int,{name}:array<struct<{fields}>>>")[name]).alias("place", "r")).select("place", "r.*")


@query("tool_recent", "select (row_number() over (order by timestamp desc, id desc) - 1)::integer as place, id, app_name as app, substr(coalesce(ocr_text, ''), 1, 500) as text from (select * from activities where status = 'ok' order by timestamp desc, id desc limit 50)")
def _(spark, d):
    return _numbers(_tools(spark, d, "text").recent_activity(80), "activities", "id:bigint,app:string,text:string")


@query("tool_by_time", "select (row_number() over (order by timestamp, id) - 1)::integer as place, id, category from (select * from activities where status = 'ok' and date = '2024-01-15' and hour(timestamp) between 9 and 23 order by timestamp, id limit 100)")
def _(spark, d):
    return _numbers(_tools(spark, d, "text").activity_by_time("2024-01-15", start_hour=9), "activities", "id:bigint,category:string")


@query("tool_audio", "select (row_number() over (order by start_time desc, id desc) - 1)::integer as place, id, app_name from (select * from meetings where contains(lower(transcript), 'thorou') or coalesce(contains(lower(summary), 'thorou'), false) order by start_time desc, id desc limit 10)")
def _(spark, d):
    return _numbers(_tools(spark, d).search_audio("Thorou"), "results", "id:bigint,app_name:string")


@query("tool_statistics", "select key, count(*)::double as value from (select category as key from activities where status = 'ok' and date between date '2024-01-20' - 7 and '2024-01-20') group by 1")
def _(spark, d):
    rows = _numbers(_tools(spark, d).statistics("2024-01-20"), "statistics", "metric:string,key:string,value:double")
    return rows.where("metric = 'category'").select("key", "value")


@query("tool_search", None)
def _(spark, d):
    return _tools(spark, d, "embedding", search=True).search_screen("thorou")


# -------------------------------------------------------------------- plug-ins


@query(
    "plugin_streaks",
    """with r as (select user_id, app_name, timestamp, id, row_number() over (partition by user_id order by timestamp, id) - row_number() over (partition by user_id, app_name order by timestamp, id) as g from activities)
    select user_id, app_name, min(timestamp) as start, max(timestamp) as "end", count(*) as n from r group by user_id, app_name, g""",
)
def _(spark, d):
    """A plug-in called as a table function of SQL."""
    from daybook.plans.registry import Streaks, register_plugin

    register_plugin(spark, "app_streaks", Streaks, {"app_streaks"})
    activities(spark, d).select("user_id", "app_name", "timestamp", "id").createOrReplaceTempView("streak_rows")
    return spark.sql("select * from app_streaks(TABLE(streak_rows), key => 'user_id')")
