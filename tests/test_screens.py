"""Screens in reading order: golden screens, random ones against a plain version, and the queries' plans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from daybook.functions import layout
from daybook.plans import catalogue
from daybook.schema import BOX, REGION

SF = "/root/testdata/sf0.001"
STAMP = "02-12-2024 20:02"


def box(x, y, said, conf=0.9, w=80):
    return {"box": [[x, y], [x + w, y], [x + w, y + 20], [x, y + 20]], "text": said, "conf": conf}


def region(name, x0, x1, kind="content", y0=0.0, y1=1.0):
    return {"name": name, "x_start": float(x0), "x_end": float(x1), "y_start": y0, "y_end": y1, "content_type": kind}


WHOLE = [region("main_content", 0.0, 1.0, "other")]


def organised(spark, screens):
    rows = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(screens)], f"i int, b array<{BOX}>, r array<{REGION}>")
    return [x["t"] for x in rows.select("i", layout.organised_text(F.col("b"), F.col("r"), F.lit(1000), F.lit(1000)).alias("t")).orderBy("i").collect()]


GOLDEN = [
    ([box(200, 12, "bb"), box(10, 0, "aa"), box(10, 40, "cc")], WHOLE, "[MAIN CONTENT]\naa  bb\ncc"),
    # the row's first box is the anchor, not the last one
    ([box(0, 0, "aa"), box(0, 20, "bb"), box(0, 40, "cc")], WHOLE, "[MAIN CONTENT]\naa  bb\ncc"),
    # a chat: a sender stands left of a timestamp
    ([box(10, 0, "Ann"), box(200, 3, STAMP), box(10, 30, "hi"), box(10, 60, "there"), box(10, 100, "Bob"), box(200, 100, STAMP), box(10, 130, "yo")], [region("talk", 0, 1, "messages")], "[TALK]\nAnn: hi | there\nBob: yo"),
    # what precedes the first sender, and senders without a word, are left out
    ([box(10, 0, "lost"), box(10, 50, "Ann"), box(200, 50, STAMP), box(10, 100, "Bob"), box(200, 100, STAMP), box(10, 130, "yo")], [region("a", 0, 1)], "[A]\nBob: yo"),
    # no sender: lines after all
    ([box(0, 0, "just"), box(100, 0, "rows")], [region("Chat", 0, 1, "navigation")], "[CHAT]\njust  rows"),
    # of two boxes to the left the nearer one speaks
    ([box(10, 0, "far"), box(100, 0, "near"), box(300, 0, STAMP), box(10, 40, "word")], [region("x", 0, 1, "unknown")], "[X]\nnear: word"),
    # a stamp in a region of another kind is a text like others
    ([box(10, 0, "Ann"), box(200, 3, STAMP), box(10, 30, "hi")], [region("x", 0, 1, "table")], f"[X]\nAnn  {STAMP}\nhi"),
    # the smaller region takes the box, regions are shown in their order, others come last
    ([box(10, 10, "menu"), box(500, 10, "body"), box(500, 60, "x"), box(500, 90, "dim", 0.2), box(400, 900, "foot")], [region("main_content", 0, 1, y1=0.5), region("side", 0, 0.2, "navigation")], "[MAIN CONTENT]\nbody\n\n[SIDE]\nmenu\n\n[OTHER]\nfoot"),
    ([], WHOLE, ""),
    ([box(0, 0, "aa")], [], ""),
    (None, WHOLE, ""),
    ([{"box": [[0, 0], [1, 0], [1, 1], [0, 1]], "text": None, "conf": None}], WHOLE, ""),
]


def test_golden_screens(spark):
    assert organised(spark, [(b, r) for b, r, _ in GOLDEN]) == [want for *_, want in GOLDEN]


def stamped(text):
    return re.search("[0-9]{2}[-./][0-9]{2}[-./][0-9]{2,4}", text)


def plain(boxes):
    lines, top = [], None
    for y, x, _, text in boxes:
        if top is None or y - top > 25:
            lines.append([])
            top = y
        lines[-1].append((x, text))
    return "\n".join("  ".join(t for _, t in sorted(line, key=lambda c: c[0])) for line in lines)


def talk(boxes):
    senders = set()
    for y, x, _, text in boxes:
        if stamped(text):
            left = [b for b in boxes if b[1] < x and abs(b[0] - y) < 15 and not stamped(b[3])]
            senders |= {max(left, key=lambda b: (b[1], -b[0], -b[2]))} if left else set()
    said = []
    for b in boxes:
        if b in senders:
            said.append((b[3], []))
        elif not stamped(b[3]) and said:
            said[-1][1].append(b[3])
    return "\n".join(f"{who}: {' | '.join(what)}" for who, what in said if what) or plain(boxes)


def brute(boxes, regions):
    found = {}
    for i, b in enumerate(boxes):
        (x, y), (x2, y2) = b["box"][0], b["box"][2]
        u, v = (x + x2) / 2 / 1000, (y + y2) / 2 / 1000
        around = [r for r in regions if r["x_start"] <= u <= r["x_end"] and r["y_start"] <= v <= r["y_end"]]
        home = min(around, key=lambda r: (r["x_end"] - r["x_start"]) * (r["y_end"] - r["y_start"]))["name"] if around else None
        if len(b["text"].strip()) > 1 and b["conf"] >= 0.3:
            found.setdefault(home, []).append((y, x, i, b["text"].strip()))
    out = []
    for r in [*regions, {"name": None}]:
        inside = sorted(found.get(r["name"], []))
        if inside:
            chat = r["name"] and (r["content_type"] == "messages" or "chat" in r["name"] or (any(stamped(b[3]) for b in inside) and r["content_type"] in ("content", "unknown", "navigation")))
            out.append(f"[{(r['name'] or 'other').upper().replace('_', ' ')}]\n{talk(inside) if chat else plain(inside)}")
    return "\n\n".join(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_screens(spark, seed):
    rng = random.Random(seed)
    screens = []
    for _ in range(120):
        boxes = [box(rng.randrange(0, 950, rng.choice([1, 50])), rng.randrange(0, 960, rng.choice([1, 7, 30])), rng.choice(["Ann", "Bob ", " hello", "x", "two words", STAMP, "at 1.2.03", "12/31/99"]), rng.choice([0.2, 0.3, 0.9]), rng.randrange(5, 90)) for _ in range(rng.randrange(1, 40))]
        names = rng.sample(["left_bar", "main", "team_chat", "list", "top"], rng.randrange(1, 5))
        edges = [sorted(rng.choices([0.0, 0.1, 0.2, 0.5, 0.7, 1.0], k=2)) + sorted(rng.choices([0.0, 0.3, 0.6, 1.0], k=2)) for _ in names]
        screens.append((boxes, [region(n, a, b, rng.choice(["content", "navigation", "messages", "table", "unknown"]), c, d) for n, (a, b, c, d) in zip(names, edges)]))
    assert organised(spark, screens) == [brute(b, r) for b, r in screens]


def test_layout_stays_out_of_python(spark):
    for name in ("organized_screens", "organized_boxes", "screen_texts"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and ("Exchange" in plan) == (name == "screen_texts")  # its boxes are gathered


def test_screens_are_counted_once(spark):
    """Boxes are counted once for each side, not again for each region that depends on the counts."""
    rows = spark.createDataFrame([([box(0, 0, "aa"), box(0, 30, "bb"), box(400, 0, "cc"), box(400, 30, "dd"), box(900, 0, "ee")],), ([],), (None,)], f"b array<{BOX}>")
    out = rows.select(layout.column_regions(F.col("b"), F.lit(1000)).alias("r"))
    assert [[(r.name, r.x_start, r.x_end) for r in x.r] for x in out.collect()] == [[("region_left", 0.0, 0.22), ("region_center", 0.22, 1.0)], [], [("main_content", 0.0, 1.0)]]
    assert out._jdf.queryExecution().analyzed().toString().count("filter(b") == 2
