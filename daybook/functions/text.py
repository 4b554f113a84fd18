"""Scalar text functions as Column expressions."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What redaction looks for, in the order it is applied, and what takes its place.
CARD = r"\b(?:\d{4}[\s\-]?){3}\d{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
KEYS = r"\b(?:sk-ant-[A-Za-z0-9\-]{20,}|sk-[A-Za-z0-9]{20,}|sk_live_[A-Za-z0-9]{20,}|sk_test_[A-Za-z0-9]{20,}|pk_live_[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{20,}|gho_[A-Za-z0-9]{36,}|AKIA[A-Z0-9]{16}|xox[bps]-[A-Za-z0-9\-]{10,}|glpat-[A-Za-z0-9\-]{20,}|AIza[A-Za-z0-9\-_]{35}|whsec_[A-Za-z0-9]{20,}|ntn_[A-Za-z0-9]{20,})\b"
JWT = r"\beyJ[A-Za-z0-9_-]{20,}\.eyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\b"
PASSWORD = r"(?i)(?:password|passwd|pwd|secret|token|api.?key)\s*[:=]\s*[\"']?(\S{4,})[\"']?"
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}\b"
RULES = {"credit_card": (CARD, "[REDACTED:card]"), "ssn": (SSN, "[REDACTED:ssn]"), "api_key": (KEYS, "[REDACTED:key]"), "jwt": (JWT, "[REDACTED:jwt]"), "password": (PASSWORD, "[REDACTED:password]"), "email": (EMAIL, "[REDACTED:email]")}
DEFAULT_RULES = ("credit_card", "ssn", "api_key", "jwt", "password")

#: Addresses that are never the page being looked at.
URL_NOISE = ("http://localhost", "http://127.0.0.1", "https://fonts.googleapis.com", "https://cdn.", "http://schemas.", "chrome-extension://")
URL = r"(?i)https?://[^\s<>\"']+|(?<![\w@./])(?:www\.)[^\s<>\"']+"

#: Words that carry no search intent.
STOPWORDS = tuple(
    """what should would could will shall how why when where which who whom that this these those have has had does did
    doing done the and but for not you your yours they them their was were been being are can may might must need with
    from about into over after before between reply respond tell say said ask asked show see look find get got give gave
    last recent latest happening going any some there also just like know to do me my is it in on at if so or no up an be
    am of i next now then than too message messages text send sent chat mail email wrote write writing hi hii hey hello
    please yeah yes thanks thank okay ok cool nice""".split()
)
#: Small talk, whole and as a word of a short question.
CASUAL = ("hi", "hii", "hey", "hello", "sup", "yo", "thanks", "thank", "bye", "goodbye", "how are you", "what's up", "whats up", "tell me a joke", "joke", "funny", "who are you", "what are you", "your name", "good morning", "good night", "good evening")
GREETINGS = ("hi", "hii", "hey", "hello", "sup", "yo", "thanks", "bye")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def parse_rules(text: str | None) -> tuple[str, ...]:
    """Names of redaction rules from a comma-separated list; unknown ones are dropped, nothing means the defaults."""
    return tuple(t for t in (x.strip() for x in text.split(",")) if t in RULES) if text else DEFAULT_RULES


def passes_luhn(digits: Column) -> Column:
    only = F.regexp_replace(digits, r"[^0-9]", "")
    return F.coalesce(F.call_function("luhn_check", only), F.lit(False)) & F.length(only).between(13, 19)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def redact(text: Column, rules: tuple[str, ...] = DEFAULT_RULES) -> Column:
    """``struct<clean_text, redacted_count, types_found, details>``. Rules apply
    in the order given, each to what the ones before left. A card is replaced
    only if its check digit is right, but its type counts as found either way."""

    def state(clean: Column, hits: Column) -> Column:
        return F.struct(clean.alias("clean"), hits.alias("hits"))

    def with_hit(s: Column, name: str, count: Column, hits: Column) -> Column:
        return F.concat(s["hits"], F.array(F.struct(F.lit(name).alias("type"), count.cast("int").alias("count"), hits.alias("hits"))))

    def card_step(s: Column, name: str, pattern: str, mark: str) -> Column:
        def replaced(found: Column) -> Column:
            # the pieces between matches, each followed by its match or by the mark
            between = F.split(F.regexp_replace(s["clean"], pattern, "\u0000"), "\u0000", -1)
            shown = F.transform(found, lambda m: F.when(passes_luhn(m), F.lit(mark)).otherwise(m))
            after = F.array_join(F.zip_with(between, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
            return state(F.when(F.size(found) > 0, after).otherwise(s["clean"]), with_hit(s, name, F.size(F.filter(found, passes_luhn)), F.size(found)))

        return bound(matches(s["clean"], pattern), replaced)

    def plain_step(s: Column, name: str, pattern: str, mark: str) -> Column:
        after = F.regexp_replace(s["clean"], pattern, mark)
        return bound(F.size(matches(s["clean"], pattern)), lambda n: state(F.when(n > 0, after).otherwise(s["clean"]), with_hit(s, name, n, n)))

    def partial_step(step: Callable[..., Column], name: str) -> Callable[[Column], Column]:
        return lambda s: step(s, name, *RULES[name])

    now = state(F.coalesce(text, F.lit("")), F.array().cast("array<struct<type:string,count:int,hits:int>>"))
    for name in rules:
        step = card_step if name == "credit_card" else plain_step
        now = bound(now, partial_step(step, name))

    def report(s: Column) -> Column:
        hit = F.filter(s["hits"], lambda x: x["hits"] > 0)
        return F.struct(
            s["clean"].alias("clean_text"),
            F.aggregate(hit, F.lit(0), lambda n, x: n + x["count"]).alias("redacted_count"),
            F.transform(hit, lambda x: x["type"]).alias("types_found"),
            F.transform(hit, lambda x: F.struct(x["type"].alias("type"), x["count"].alias("count"))).alias("details"),
        )

    return bound(now, report)


def urls(text: Column) -> Column:
    """Distinct addresses in order, without closing punctuation, noise and very short ones."""
    found = F.transform(matches(F.coalesce(text, F.lit("")), URL), lambda u: F.regexp_replace(u, r"[.,;:)\]'\"]+$", ""))
    found = F.filter(found, lambda u: F.length(u) >= 10)
    found = F.filter(found, lambda u: ~F.exists(F.array(*[F.lit(n) for n in URL_NOISE]), lambda n: F.startswith(u, n)))
    return bound(found, lambda v: bound(F.transform(v, F.lower), lambda low: F.filter(v, lambda u, i: F.array_position(low, F.lower(u)) == i + 1)))


def first_url(text: Column) -> Column:
    return F.get(urls(text), F.lit(0))


def host(url: Column, width: int = 50) -> Column:
    """Host name in lower case, else the first characters."""
    return F.coalesce(F.nullif(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("")), F.substring(url, 1, width))


def keywords(question: Column) -> Column:
    """Words of a question that are worth searching for."""
    words = F.transform(F.split(F.trim(F.regexp_replace(F.lower(question), r"\s+", " ")), " "), lambda w: F.regexp_replace(w, r"^[?!.,;:'\"]+|[?!.,;:'\"]+$", ""))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


def is_casual(question: Column) -> Column:
    low = F.lower(question)
    words = F.array_distinct(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    return F.regexp_replace(low, r"^[?!. ]+|[?!. ]+$", "").isin(*CASUAL) | ((F.size(words) <= 2) & F.exists(words, lambda w: w.isin(*GREETINGS)))


def vocabulary(text: Column) -> Column:
    """Sorted distinct words of more than two characters."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.length(w) > 2)
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def embedding_text(summary: Column, scene: Column, details: Column, app: Column, category: Column, visible: Column) -> Column:
    """The text that stands for an activity when it is embedded."""
    some = lambda c, shown=None: F.when(F.coalesce(c, F.lit("")) != "", c if shown is None else shown)
    shown = F.when(F.size(F.coalesce(visible, F.array().cast("array<string>"))) > 0, F.concat(F.lit("Visible: "), F.array_join(F.slice(visible, 1, 5), " | ")))
    return F.concat_ws(". ", some(summary), some(scene, F.substring(scene, 1, 500)), some(details), some(app, F.concat(F.lit("Application: "), app)), some(category, F.concat(F.lit("Category: "), category)), shown)


#: Signs of window chrome in accessibility text, and what parts it from recognised text.
CHROME_MARKERS = (
    "minimize", "maximize", "restore", "close",
    "tab bar", "app bar", "address and search bar",
    "has access to this site", "no access needed",
    "memory usage", "sleeping", "extensions",
)
PICTURE_MARK = "\n--- (from image OCR) ---\n"


def is_content(text: Column, markers: tuple[str, ...] = CHROME_MARKERS) -> Column:
    """Long text (over 100 characters but for white space at its ends) with fewer than three signs of window chrome."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    seen = F.size(F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(low, m)))
    return (F.length(strip(text)) > 100) & (seen < 3)


def merge_screen_texts(accessible: Column, recognised: Column) -> Column:
    """``struct<text, method>`` of a screen that was read through accessibility
    and by recognition; either may be null or empty.

    Accessibility text that is content comes first; of the recognised text only
    lines of more than three characters follow that it does not contain,
    whatever their case. Text of window chrome precedes the recognised text as
    a whole. Method is ``a11y``, ``ocr``, ``a11y+ocr`` or ``none``; chrome of
    more than 20 characters without recognised text counts as ``a11y``, but no
    text is kept of it."""
    said, seen = F.coalesce(accessible, F.lit("")), F.coalesce(recognised, F.lit(""))
    low = F.lower(said)
    lines = F.transform(F.split(seen, "\n"), strip)
    extras = F.filter(lines, lambda x: (F.length(x) > 3) & ~F.contains(low, F.lower(x)))
    content = is_content(said)
    both = lambda more: F.concat(said, F.lit(PICTURE_MARK), more)
    text = (
        F.when(content & (F.size(extras) > 0), both(F.array_join(extras, "\n")))
        .when(content, said)
        .when((seen != "") & (said != ""), both(seen))
        .when(seen != "", seen)
    )
    method = (
        F.when(content, F.when(F.size(extras) > 0, "a11y+ocr").otherwise("a11y"))
        .when(seen != "", F.when(said != "", "a11y+ocr").otherwise("ocr"))
        .when(F.length(strip(said)) > 20, "a11y")
        .otherwise("none")
    )
    return F.struct(text.alias("text"), method.alias("method"))


def first_keyword(text: Column, words: list[str]) -> Column:
    """The first of ``words`` that the text contains; null if none."""
    known = [w.strip().lower() for w in words if w.strip()]
    return F.get(F.filter(F.array(*[F.lit(w) for w in known]), lambda w: F.contains(F.lower(F.coalesce(text, F.lit(""))), w)), F.lit(0))


def snippet(text: Column, query: str, around: int = 80, otherwise: int = 200) -> Column:
    """The text around the first hit of ``query``, marked where it is cut."""
    text = F.coalesce(text, F.lit(""))
    at = F.instr(F.lower(text), query.lower())
    start = F.greatest(F.lit(0), at - 1 - around)
    end = F.least(F.length(text), at - 1 + len(query) + around)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, otherwise))


def _quoted(word: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else f"\\{c}" for c in word)


def highlight(text: Column, query: str) -> Column:
    """Words of the query of more than two characters, wrapped in marks."""
    words = [w for w in query.split() if len(w) > 2]
    return F.regexp_replace(text, "(?i)(" + "|".join(map(_quoted, words)) + ")", "<mark>$1</mark>") if words else text


def matching_lines(text: Column, words: list[str], most: int = 10) -> Column:
    """The first lines of more than two characters that contain one of the words."""
    low = F.array(*[F.lit(w.lower()) for w in words])
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: (F.length(F.trim(x)) > 2) & F.exists(low, lambda w: F.contains(F.lower(x), w)))
    return F.slice(lines, 1, most)


def chunks(text: Column, width: int = 3000, longer_than: int = 4000) -> Column:
    """Pieces of fixed width of a long text; a shorter one stays whole."""
    count = F.ceil(F.length(text) / F.lit(width)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.substring(text, i * width + 1, F.lit(width)))
    return F.when(F.length(text) > longer_than, cut).otherwise(F.array(text))


def shorten(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def safe_name(name: Column) -> Column:
    """Letters, digits, underscore and hyphen only."""
    return F.coalesce(F.nullif(F.regexp_replace(F.coalesce(name, F.lit("")), "[^a-zA-Z0-9_-]", ""), F.lit("")), F.lit("unknown"))


def schedule_seconds(schedule: Column) -> Column:
    """``every 30m``, ``every 2h``, ``daily``; anything else is six hours."""
    s = F.lower(F.trim(schedule))
    minutes = F.regexp_extract(s, r"^every\s+(\d+)\s*m(?:in)?", 1)
    hours = F.regexp_extract(s, r"^every\s+(\d+)\s*h(?:our)?", 1)
    return F.when(minutes != "", minutes.cast("int") * 60).when(hours != "", hours.cast("int") * 3600).when(F.contains(s, F.lit("daily")), 86400).otherwise(21600)


def adjusted_confidence(confidence: Column, summary: Column) -> Column:
    """Zero with a summary that tells of no failure is 0.7; within 0 and 1."""
    fine = (F.coalesce(summary, F.lit("")) != "") & ~F.contains(F.lower(summary), F.lit("failed"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when((confidence == 0) & fine, 0.7).otherwise(confidence)))


def section_hints(text: Column) -> Column:
    """Names in ``[SECTION]`` headers."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\[([A-Z][A-Z0-9 ]*)\]"), F.lit(1)))


def context_text(organised: Column, ocr: Column, width: int = 3000) -> Column:
    """Organised text, else recognised text, cut; null if there is neither."""
    return F.substring(F.coalesce(F.nullif(F.trim(organised), F.lit("")), F.nullif(F.trim(ocr), F.lit(""))), 1, width)


def header_map(text: Column) -> Column:
    """``Key: Value`` lines as a map."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def paths(text: Column) -> Column:
    """File paths: Windows ones, rooted ones, then relative ones with an extension."""
    sep = F.lit("/")
    relative = F.filter(matches(text, r"\b[\w./\\-]+\.\w{1,4}\b"), lambda p: F.contains(p, sep) | F.contains(p, F.lit("\\")))
    return F.concat(matches(text, r"[A-Za-z]:\\[^\s:*?\"<>|]+"), matches(text, r"(?:~|/)[^\s:*?\"<>|]+"), relative)


def shortstat(text: Column) -> tuple[Column, Column]:
    """Insertions and deletions of a version-control summary line."""
    number = lambda word: F.coalesce(F.nullif(F.regexp_extract(text, rf"(\d+) {word}", 1), F.lit("")).cast("int"), F.lit(0))
    return number("insertion"), number("deletion")


def changed_files(unstaged: Column, staged: Column, untracked: Column, most: int = 15) -> Column:
    none = F.array().cast("array<string>")
    return F.slice(F.array_sort(F.array_union(F.array_union(F.coalesce(unstaged, none), F.coalesce(staged, none)), F.slice(F.coalesce(untracked, none), 1, 10))), 1, most)


def normalised_audio(samples: Column, peak: float = 0.85) -> Column:
    """Samples scaled to 85 % of full range unless nearly silent."""
    top = F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x))), F.lit(0.0))
    return F.when(top > 0.001, F.transform(samples, lambda x: x * (F.lit(peak) / top))).otherwise(samples)


def to_int16(samples: Column) -> Column:
    return F.transform(samples, lambda x: (x * 32767).cast("int").cast("smallint"))


def blocks(text: Column, width: int = 2000) -> Column:
    """Paragraphs split on blank lines, each cut to a page block."""
    return F.transform(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.substring(x, 1, width))


def decode_array(text: Column) -> Column:
    """A JSON array of strings; a malformed one is empty, a missing or empty one stays missing."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>")))


def decode_counts(text: Column) -> Column:
    """A JSON object of counts; a missing one is empty."""
    return F.coalesce(F.from_json(text, "map<string,int>"), F.create_map().cast("map<string,int>"))


def decode_vector(blob: Column) -> Column:
    """Little-endian 32-bit floats of a binary column."""
    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if not v else np.frombuffer(v[: len(v) // 4 * 4], dtype="<f4").tolist() for v in values], dtype=object)

    return run(blob)


def encode_vector(vector: Column) -> Column:
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else np.asarray(v, dtype="<f4").tobytes() for v in values], dtype=object)

    return run(vector)


def signature(secret: Column, payload: Column) -> Column:
    """``sha256=`` and the keyed digest of a payload: no built-in function makes one."""
    @F.pandas_udf("string")
    def run(keys: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([None if not k or b is None else "sha256=" + hmac.new(k.encode(), b.encode(), hashlib.sha256).hexdigest() for k, b in zip(keys, bodies, strict=True)], dtype=object)

    return run(secret, payload)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))
