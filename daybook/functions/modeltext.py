"""Records out of a model's free-form answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.functions.text import bound

RECORD = "struct<app_name:string,activity_category:string,activity_summary:string,detailed_context:string,mood:string,confidence:double>"
UNPARSED = "Unable to parse response"


def without_thinking(text: Column) -> Column:
    """What follows the model's thinking, and without its unused marks."""
    tagged = F.contains(text, F.lit("<think>")) & F.contains(text, F.lit("</think>"))
    out = F.when(tagged, F.trim(F.substring_index(text, "</think>", -1))).otherwise(text)
    out = F.when(F.contains(out, F.lit("...done thinking.")), F.trim(F.substring_index(out, "...done thinking.", -1))).otherwise(out)
    return F.regexp_replace(out, "<unused\\d+>", "")


#: A string (its end may be missing), a bracket, a comma, or what lies between.
_PIECE = r'"(?:[^"\\]|\\(?s:.))*+"?|[{}\[\],]|[^"{}\[\],]+'
_WHOLE_STRING = r'(?s)^"(?:[^"\\]|\\.)*+"$'


def json_object(text: Column) -> Column:
    """The first object of a text, mended while it is read; null without one.

    One scan from the first brace keeps what is still to be closed. It ends where
    the object is closed, or closes what the text's end left open, innermost
    first. A comma waits until something follows it, so a trailing one goes. Line
    ends inside strings are escaped, a string without an end gets one."""
    rest = F.get(F.regexp_extract_all(text, F.lit(r"(?s)\{.*"), F.lit(0)), F.lit(0))
    pieces = F.regexp_extract_all(rest, F.lit(_PIECE), F.lit(0))
    state = F.struct(F.lit("").alias("out"), F.lit("").alias("open"), F.lit("").alias("comma"), F.lit(False).alias("done"))

    def then(s: Column, out: Column, opened: Column, comma: str) -> Column:
        return F.struct(out.alias("out"), opened.alias("open"), F.lit(comma).alias("comma"), (opened == "").alias("done"))

    def step(s: Column, piece: Column) -> Column:
        string = F.concat(F.replace(piece, F.lit("\n"), F.lit("\\n")), F.when(F.rlike(piece, F.lit(_WHOLE_STRING)), "").otherwise('"'))
        upto = F.instr(s["open"], piece)  # a bracket that closes more than the innermost
        said = F.concat(s["out"], s["comma"])
        return (
            F.when(s["done"], s)
            .when(piece == ",", then(s, s["out"], s["open"], ","))
            .when(piece == "{", then(s, F.concat(said, piece), F.concat(F.lit("}"), s["open"]), ""))
            .when(piece == "[", then(s, F.concat(said, piece), F.concat(F.lit("]"), s["open"]), ""))
            .when(piece.isin("}", "]"), F.when(upto > 0, then(s, F.concat(s["out"], F.substr(s["open"], F.lit(1), upto)), F.substr(s["open"], upto + 1), "")).otherwise(s))
            .when(F.startswith(piece, F.lit('"')), then(s, F.concat(said, string), s["open"], ""))
            .when(F.trim(F.regexp_replace(piece, "\\s", "")) == "", s)
            .otherwise(then(s, F.concat(said, piece), s["open"], ""))
        )

    return F.aggregate(pieces, state, step, lambda s: F.concat(s["out"], s["open"]))


def _valid(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


_FIELD = r'(\w+)"?\s*[:=]\s*"([^"]+)"'


def salvaged(text: Column) -> Column:
    """The first value told for each field, wherever it stands; null without a summary."""
    told = F.arrays_zip(F.regexp_extract_all(text, F.lit(_FIELD), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(_FIELD), F.lit(2)).alias("value"))
    plain = dict(app_name="unknown", activity_category="other", activity_summary=UNPARSED, detailed_context="", mood="neutral")

    def record(told: Column) -> Column:
        first = lambda name: F.get(F.filter(told, lambda x: F.lower(x["name"]) == name), 0)["value"]
        return F.struct(*(F.coalesce(F.nullif(F.trim(first(k)), F.lit("")), F.lit(v)).alias(k) for k, v in plain.items()), F.lit(0.3).alias("confidence"))

    return bound(bound(told, record), lambda r: F.when(r["activity_summary"] != UNPARSED, r))


def parsed(text: Column) -> Column:
    """The record of an answer: its object read, else salvaged, else null."""
    plain = dict(app_name="unknown", activity_category="other", activity_summary="", detailed_context="", mood="neutral", confidence=0.0)
    filled = lambda read: F.when(read.isNotNull(), F.struct(*(F.coalesce(read[k], F.lit(v)).alias(k) for k, v in plain.items())))
    read = lambda found: F.when(_valid(found), F.from_json(found, RECORD.removeprefix("struct<").removesuffix(">").replace(":", " ")))
    return bound(text, lambda t: F.coalesce(bound(bound(json_object(t), read), filled), salvaged(t)))


#: The region that stands for a whole screen, and what a region lacks if it is not told.
WHOLE_SCREEN = {"name": "full_screen", "x_start": 0.0, "x_end": 1.0, "y_start": 0.0, "y_end": 1.0, "content_type": "unknown"}


def array_objects(text: Column) -> Column:
    """The whole objects of the first array of a text, as texts; what is broken off is left out.

    One scan from the first bracket counts how deep it is: an object begins and
    ends one level below the array, and the array's own end ends the scan."""
    rest = F.get(F.regexp_extract_all(text, F.lit(r"(?s)\[.*"), F.lit(0)), F.lit(0))
    pieces = F.regexp_extract_all(rest, F.lit(_PIECE), F.lit(0))
    state = F.struct(F.lit(0).alias("depth"), F.lit("").alias("here"), F.array().cast("array<string>").alias("found"), F.lit(False).alias("done"))

    def step(s: Column, piece: Column) -> Column:
        depth = s["depth"] + F.when(piece.isin("{", "["), 1).when(piece.isin("}", "]"), -1).otherwise(0)
        inside = (s["depth"] > 1) | (depth > 1)
        here = F.when(inside, F.concat(s["here"], piece)).otherwise("")
        ends = (piece == "}") & (depth == 1)
        after = F.struct(depth.alias("depth"), F.when(ends, "").otherwise(here).alias("here"), F.when(ends, F.array_append(s["found"], here)).otherwise(s["found"]).alias("found"), (depth == 0).alias("done"))
        return F.when(s["done"], s).otherwise(after)

    return F.coalesce(F.aggregate(pieces, state, step, lambda s: s["found"]), F.array().cast("array<string>"))


def regions_of(text: Column) -> Column:
    """Regions of a model's answer, whatever stands around its array and even if
    that is broken off. Objects without name, x_start or x_end are left out, other
    fields have defaults; if an object can't be read or none is left, it is the whole screen."""
    whole = F.array(F.struct(*(F.lit(v).alias(k) for k, v in WHOLE_SCREEN.items())))
    needed = F.array(*(F.lit(k) for k in ("name", "x_start", "x_end")))

    def read(objects: Column) -> Column:
        told = F.filter(objects, lambda o: F.size(F.array_except(needed, F.json_object_keys(o))) == 0)
        value = lambda o, k: F.get_json_object(o, f"$.{k}")
        number = lambda o, k: F.coalesce(value(o, k).try_cast("double"), F.lit(WHOLE_SCREEN[k]) if k.startswith("y") else F.lit(None).cast("double")).alias(k)
        found = F.transform(told, lambda o: F.struct(value(o, "name").alias("name"), *(number(o, k) for k in ("x_start", "x_end", "y_start", "y_end")), F.coalesce(value(o, "content_type"), F.lit(WHOLE_SCREEN["content_type"])).alias("content_type")))
        return F.when(F.exists(objects, lambda o: ~_valid(o)) | (F.size(told) == 0), whole).otherwise(found)

    return bound(array_objects(text), read)
