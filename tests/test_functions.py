"""Scalar functions on golden strings and boxes."""

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from daybook.functions import layout, modeltext, text, titles
from daybook.operators import search
from daybook.plans import catalogue, derived  # noqa: F401  derived registers more queries


def one(spark, column, **values):
    schema = ", ".join(f"`{k}` {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (1,)
    value = spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]
    return value.asDict(recursive=True) if hasattr(value, "asDict") else value


def on(spark, f, value, kind="string"):
    return one(spark, f(F.col("v")), v=(kind, value))


@pytest.mark.parametrize(
    "said,clean,types",
    [
        ("card 4111-1111-1111-1111 end", "card [REDACTED:card] end", [("credit_card", 1)]),
        ("card 1234-5678-9012-3456 end", "card 1234-5678-9012-3456 end", [("credit_card", 0)]),
        ("4111111111111111 and 1234567890123456", "[REDACTED:card] and 1234567890123456", [("credit_card", 1)]),
        ("ssn 123-45-6789 key sk-" + "a" * 24 + " card 4111 1111 1111 1111", "ssn [REDACTED:ssn] key [REDACTED:key] card [REDACTED:card]", [("credit_card", 1), ("ssn", 1), ("api_key", 1)]),
        ("eyJabc.eyJdef.xyz", "eyJabc.eyJdef.xyz", []),
        ("password: hunter22", "[REDACTED:password]", [("password", 1)]),
        ("mail a@b.org", "mail a@b.org", []),
        (None, "", []),
        ("", "", []),
    ],
)
def test_redaction(spark, said, clean, types):
    r = on(spark, text.redact, said)
    assert r["clean_text"] == clean
    assert [(x["type"], x["count"]) for x in r["details"]] == types and r["types_found"] == [t for t, _ in types]
    assert r["redacted_count"] == sum(c for _, c in types)


def test_redaction_options(spark):
    assert on(spark, lambda c: text.redact(c, ("email",)), "mail a@b.org")["clean_text"] == "mail [REDACTED:email]"
    assert text.parse_rules("ssn, nope ,email") == ("ssn", "email") and text.parse_rules("") == text.DEFAULT_RULES


def test_urls(spark):
    said = "see https://a.org/x. and www.b.org/y), HTTPS://A.ORG/x http://localhost:80/q me@www.c.org ftp http://d.e"
    assert on(spark, text.urls, said) == ["https://a.org/x", "www.b.org/y", "http://d.e"]
    assert on(spark, text.first_url, None) is None
    assert on(spark, text.host, "https://Ex.Org:8/p") == "ex.org" and on(spark, text.host, "nothing here") == "nothing here"


def test_words(spark):
    assert on(spark, text.keywords, "What did I see about 'Spark', and Delta?") == ["spark", "delta"]
    assert on(spark, text.is_casual, "Hey!") and on(spark, text.is_casual, "hello there") and not on(spark, text.is_casual, "deploy notes from monday")
    assert on(spark, text.schedule_seconds, "every 30min") == 1800 and on(spark, text.schedule_seconds, "every 2 hours") == 7200 and on(spark, text.schedule_seconds, "x") == 21600
    assert on(spark, text.safe_name, "a b/../c!") == "abc" and on(spark, text.safe_name, "!!") == "unknown"
    assert on(spark, lambda c: text.snippet(c, "Needle", 3, 5), "0123456needle789xyz") == "...456needle789..."
    assert on(spark, lambda c: text.snippet(c, "zz", 3, 5), "0123456") == "01234"
    assert on(spark, lambda c: text.highlight(c, "c++ is fun"), "C++ was Fun") == "<mark>C++</mark> was <mark>Fun</mark>"
    assert on(spark, text.header_map, "A: b\n x : y:z \nno") == {"A": "b", "x": "y:z"}
    assert on(spark, text.blocks, "a\n\n b \n\n\n\nc") == ["a", "b", "c"]
    assert on(spark, text.section_hints, "[TOP BAR]\nx\n[SIDE]\n[no]") == ["TOP BAR", "SIDE"]
    assert on(spark, text.paths, r"C:\a\b.py and ~/x/y src/main.py plain.txt") == [r"C:\a\b.py", "~/x/y", "/main.py", r"a\b.py", "src/main.py"]
    ins, dels = text.shortstat(F.col("v"))
    assert one(spark, F.array(ins, dels), v=("string", " 3 files changed, 12 insertions(+), 4 deletions(-)")) == [12, 4]
    assert on(spark, text.decode_array, "[bad") == [] and on(spark, text.decode_array, '["a"]') == ["a"] and on(spark, text.decode_array, None) is None
    assert on(spark, text.decode_counts, None) == {} and on(spark, text.decode_counts, '{"a": 2}') == {"a": 2}
    assert one(spark, text.changed_files(F.col("a"), F.col("b"), F.col("c")), a=("array<string>", ["z", "a"]), b=("array<string>", ["a"]), c=("array<string>", ["m"] * 12)) == ["a", "m", "z"]


def test_vectors_audio_signature(spark):
    back = one(spark, text.decode_vector(text.encode_vector(F.col("v"))), v=("array<float>", [1.5, -2.0]))
    assert back == [1.5, -2.0]
    assert on(spark, text.normalised_audio, [0.1, -0.5], "array<double>") == pytest.approx([0.17, -0.85])
    assert on(spark, text.normalised_audio, [0.0005], "array<double>") == [0.0005]
    assert on(spark, text.to_int16, [1.0, -1.0], "array<double>") == [32767, -32767]
    import hashlib
    import hmac

    assert one(spark, text.signature(F.col("k"), F.col("b")), k=("string", "s"), b=("string", "{}")) == "sha256=" + hmac.new(b"s", b"{}", hashlib.sha256).hexdigest()


@pytest.mark.parametrize(
    "app,kind,hint,title,want",
    [
        ("VS Code", "coding", "Alacritty", "user@host: ~", ("Alacritty", "terminal")),
        ("VS Code", "coding", "code", None, ("VS Code", "coding")),
        ("Unknown", "coding", "electron", "Notes - AnyType", ("AnyType", "writing")),
        ("Chrome", "Media content", "chrome", "Song - YouTube - Google Chrome", ("Google Chrome", "media")),
        ("Player", "other", "mpv", "mpv - movie.mkv", ("mpv", "media")),
        ("Thing", "browsing the web", None, "Calculator", ("Calculator", "browsing")),
        ("Thing", "nonsense", "java", "/home/x", ("Thing", "other")),
        ("Jenkins", "coding", "firefox", "Build Log - Jenkins", ("Jenkins", "coding")),
        ("Steam Store", "media", "st", None, ("st", "terminal")),
        ("Teams", "communication", "ms-teams", "Chat | Microsoft Teams", ("ms-teams", "communication")),
    ],
)
def test_reconciliation(spark, app, kind, hint, title, want):
    r = one(spark, titles.reconcile(F.col("a"), F.col("k"), F.col("h"), F.col("t")), a=("string", app), k=("string", kind), h=("string", hint), t=("string", title))
    assert (r["app_name"], r["category"]) == want


def test_titles(spark):
    assert on(spark, titles.app_from_title, "main.py - proj – Visual Studio") == "proj – Visual Studio"
    assert on(spark, titles.app_from_title, "a – b.txt") is None and on(spark, titles.app_from_title, None) is None
    assert on(spark, titles.mood, "quite Productive, learning") == "productive" and on(spark, titles.mood, None) == "neutral"
    assert one(spark, titles.is_coding(F.col("k"), F.col("a"), F.col("t")), k=("string", None), a=("string", "Code.exe"), t=("string", None))
    assert not one(spark, titles.is_coding(F.col("k"), F.col("a"), F.col("t")), k=("string", "media"), a=("string", "vlc"), t=("string", "film"))
    assert not one(spark, titles.is_more_specific(F.lit("vim"), F.lit("neovim"))) and one(spark, titles.is_more_specific(F.lit("code"), F.lit("vs code")))


RECORD = '{"app_name": "A", "activity_category": "coding", "activity_summary": "S", "detailed_context": "D", "mood": "neutral", "confidence": 0.9}'


@pytest.mark.parametrize(
    "raw,summary,confidence",
    [
        (RECORD, "S", 0.9),
        (f"text\n```json\n{RECORD}\n```\nmore", "S", 0.9),
        (f"Sure: {RECORD} done", "S", 0.9),
        (RECORD[:-1] + ",}", "S", 0.9),
        ('{"activity_summary": "a\nb",}', "a\nb", 0.0),
        ('app_name: "A" activity_summary: "kept"', "kept", 0.3),
    ],
)
def test_model_answers(spark, raw, summary, confidence):
    r = on(spark, modeltext.parsed, raw)
    assert (r["activity_summary"], r["confidence"]) == (summary, confidence)


def test_model_answers_without_record(spark):
    assert on(spark, modeltext.parsed, "nothing") is None and on(spark, modeltext.parsed, None) is None
    assert on(spark, modeltext.without_thinking, "<think>a</think> b") == "b" and on(spark, modeltext.without_thinking, "x ...done thinking. y<unused12>") == "y"


def box(x, y, said, conf=0.9, w=80):
    return {"box": [[x, y], [x + w, y], [x + w, y + 20], [x, y + 20]], "text": said, "conf": conf}


def test_layout_regions(spark):
    from daybook.schema import BOX

    boxes = [box(10, 0, "a"), box(10, 50, "b"), box(900, 0, "c"), box(900, 50, "d"), box(1800, 0, "e")]
    got = one(spark, layout.column_regions(F.col("b"), F.lit(1920)), b=(f"array<{BOX}>", boxes))
    assert [(r["name"], r["x_start"], r["x_end"]) for r in got] == [("region_left", 0.0, 0.22), ("region_center", 0.22, 1.0)]
    assert one(spark, layout.column_regions(F.col("b"), F.lit(1920)), b=(f"array<{BOX}>", [])) == []
    hit = one(spark, layout.highlights(F.col("b"), "of AAA", F.lit(100), F.lit(100)), b=(f"array<{BOX}>", [box(2, 2, "xaaay"), box(50, 50, "no")]))
    assert [(h["x1"], h["y1"], h["x2"], h["y2"]) for h in hit] == [(0, 0, 86, 26)]
    from daybook.schema import REGION

    percent = [{"name": "a", "x_start": 0.0, "x_end": 50.0, "y_start": 0.0, "y_end": 100.0, "content_type": "x"}]
    assert one(spark, layout.fractions(F.col("r")), r=(f"array<{REGION}>", percent))[0]["x_end"] == 0.5


@pytest.mark.parametrize("match,phrases", [('"alpha"', [["alpha"]]), ('"alpha" OR "beta"', [["alpha"], ["beta"]]), ('"alpha beta"', [["alpha", "beta"]]), ('"a a"', [["a", "a"]])])
def test_bm25_equals_fts5(spark, match, phrases):
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "délta", "a", "x1", "the"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12))), ", ".join(rng.choices(words, k=rng.randint(0, 5)))) for i in range(1, 80)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(one, two)")
    db.executemany("insert into t(rowid, one, two) values (?, ?, ?)", rows)
    want = dict(db.execute("select rowid, bm25(t) from t where t match ?", (match,)).fetchall())
    got = {r.id: r.score for r in search.bm25(spark.createDataFrame(rows, "id long, one string, two string"), ["one", "two"], phrases).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


CHROME = ["minimize", "maximize", "restore", "close", "tab bar", "app bar", "address and search bar", "has access to this site", "no access needed", "memory usage", "sleeping", "extensions"]


def merged(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, o string")
    return [tuple(r["m"]) for r in df.select("i", text.merge_screen_texts(F.col("a"), F.col("o")).alias("m")).orderBy("i").collect()]


def test_chrome_is_told_by_three_of_twelve_signs(spark):
    long = "some words of a document that goes on for more than a hundred characters so that it can count as content "
    rows = [(m, f"{long} {m.upper()} {CHROME[i - 1]} {CHROME[i - 2]}") for i, m in enumerate(CHROME)] + [("two", f"{long} close Close extensions"), ("long", long), ("short", "x" * 100 + " " * 50), ("edge", "x" * 101), ("null", None)]
    got = dict(spark.createDataFrame(rows, "k string, t string").select("k", text.is_content(F.col("t"))).collect())
    assert got == {**dict.fromkeys(CHROME, False), "two": True, "long": True, "short": False, "edge": True, "null": False}


def test_two_texts_of_a_screen(spark):
    content = "Notes of the day: the quick brown fox jumps over the lazy dog, again and again, until it gets dark and cold outside."
    chrome = "Minimize Maximize Close Address and search bar"
    mark = "\n--- (from image OCR) ---\n"
    assert merged(spark, [(content, None), (content, "QUICK BROWN FOX\n  new line \nabc\n\nmore here"), (content, " lazy dog \nfox"), (chrome, "all of\n it "), (None, "seen"), ("", "seen"), (chrome, None), ("tiny", ""), (None, None), ("tiny", "seen")]) == [
        (content, "a11y"),
        (content + mark + "new line\nmore here", "a11y+ocr"),
        (content, "a11y"),
        (chrome + mark + "all of\n it ", "a11y+ocr"),
        ("seen", "ocr"),
        ("seen", "ocr"),
        (None, "a11y"),
        (None, "none"),
        (None, "none"),
        ("tiny" + mark + "seen", "a11y+ocr"),
    ]


SCREEN = ("full_screen", 0.0, 1.0, 0.0, 1.0, "unknown")
A, PLAIN_A = '{"name": "a", "x_start": 0, "x_end": 0.5}', ("a", 0.0, 0.5, 0.0, 1.0, "unknown")
FULL = '{"name": "b [x] {y}", "x_start": 10, "x_end": 50.5, "y_start": 0.1, "y_end": 0.9, "content_type": "chat", "more": {"z": [1]}}'
PLAIN_FULL = ("b [x] {y}", 10.0, 50.5, 0.1, 0.9, "chat")


@pytest.mark.parametrize(
    "raw,want",
    [
        (f"[{A}, {FULL}]", [PLAIN_A, PLAIN_FULL]),
        (f"```json\n[{A}]\n```", [PLAIN_A]),
        (f"Here they are:\n[{A},\n {FULL}\n] as asked.", [PLAIN_A, PLAIN_FULL]),
        (f'{{"regions": [{A}]}}', [PLAIN_A]),
        (f'[{A}, {{"name": "c", "x_st', [PLAIN_A]),
        (f'[{FULL}, {A}, {{"name": "never end', [PLAIN_FULL, PLAIN_A]),
        (f"[{A},]", [PLAIN_A]),
        (f'[{{"name": "c", "x_start": 1}}, {A}]', [PLAIN_A]),
        (f"[{A}, {{name: 1}}]", [SCREEN]),
        ('[{"x_start": 0, "x_end": 1}]', [SCREEN]),
        ("[1]", [SCREEN]),
        ("[]", [SCREEN]),
        ("junk", [SCREEN]),
        ("", [SCREEN]),
        (None, [SCREEN]),
    ],
)
def test_regions_of_an_answer(spark, raw, want):
    got = on(spark, modeltext.regions_of, raw)
    assert [tuple(r.asDict().values()) if hasattr(r, "asDict") else tuple(r.values()) for r in got] == want



def test_a_scan_splits_a_long_text_once(spark):
    import time

    df = spark.createDataFrame([(1, "of the " * 20_000), (2, "of it")], "id long, text string")
    start = time.monotonic()
    assert sorted(r.id for r in search.bm25(df, ["text"], [["of", "the"]]).collect()) == [1]
    assert time.monotonic() - start < 30  # seconds; splitting it for each of its words takes minutes


def plain_category(app):
    """The rules one after another, as the reference states them."""
    name = re.sub(r"[-. ]+$", "", app.strip(" ").lower())
    for test in (lambda k: k == name, lambda k: name.startswith(k) or (k.startswith(name) and len(name) >= 5 and len(name) >= len(k) - 3), lambda k: re.search(rf"\b{re.escape(k)}\b", name)):
        for k, kind in titles.KNOWN.items():
            if test(k):
                return kind


def test_known_category_makes_no_pattern_of_a_row(spark):
    names = [*titles.KNOWN, *(k[:n] for k in titles.KNOWN for n in range(1, len(k))), *(f"my {k} app" for k in titles.KNOWN), *(f"x{k}y" for k in titles.KNOWN), *(f"{k}-9. " for k in titles.KNOWN), "slack zoom", "é zoom", "ézoom", "", "  ", "Teams Discord", "vlc notion"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", titles.known_category(F.col("n")).alias("kind"))
    assert {r.n: r.kind for r in rows.collect()} == {n: plain_category(n) for n in names}
    assert "concat((?U)" not in rows._jdf.queryExecution().toString()


def test_model_answers_are_read_once(spark):
    plan = catalogue.QUERIES["model_answers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and plan.count("(?s)\\{.*") == 1
