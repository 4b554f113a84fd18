"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by (host, path). Every page is compared with the nearest ones
of its host, ``NEIGHBOURS`` on either side. The lines of both pages, menus and
footers included, are aligned by their longest common subsequence, and shared
lines are deleted: they belong to the site, not to the page. A neighbour that
shares every line of a page is a copy of it and tells nothing.

Differencing alone is not right in two ways, so page structure helps where it
cannot see. Menus, adverts and footers that no neighbour repeats are not
shared: of the lines that differencing leaves, those of elements that are
navigation, adverts, forms, comments and the like by tag, role or class go, and
where a page marks its article, text outside it goes. And copies of an article
share paragraphs that are no boilerplate: text elements (paragraphs, headings,
list items, cells, quotes) of a marked article stay though shared.

A line is the text of one block: references decoded, runs of white space one
space, trimmed. The text of a page is its remaining lines joined by one space.
Besides it every row tells how many lines its page has (``n_lines``), how many
differencing deletes (``n_shared``), and how many only structure does
(``n_marked``).

Work and memory grow with a page's length, not with its square: a page whose
quotes do not close is read without regard to quotes from there on, open
elements are looked up by name, and long alignments are halved (see
``shared_lines``).

Defined results: a null or empty page has the empty text; a null or relative
URL counts as host '' with the URL as path. Repeated rows come out alike and
are one page when pages are compared. Pages are read whole; other columns of
the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import stash, tidy

NEIGHBOURS = 2  # compared pages on either side
BLOCK_PAGES = 256  # pages that one block of the comparison holds, besides its neighbours
DIRECT_BITS = 1 << 26  # cells of an alignment that is kept whole
OFTEN = 64  # places of a line from which on its bits are kept

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_TAG = re.compile(_NAME.pattern + r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)

# what HTML defines
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd blockquote pre figcaption caption".split())
ARTICLE = frozenset("article main".split())
_SHUTS_P = BLOCK - frozenset("br option summary legend caption td th tr tbody thead tfoot body html head".split())
#: an opening tag ends the nearest open element of the first kind, unless one of the second kind is nearer
_ENDS = {
    "p": ("p", "div article section body td li blockquote aside nav form main"),
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "option": ("option", "select"),
}
#: of each element: whose endings it marks when it opens, and whose it hides
_MARKS = {tag: (tuple(of for of, (shut, _) in _ENDS.items() if tag in shut.split()), tuple(of for of, (_, within) in _ENDS.items() if tag in within.split())) for tag in {x for pair in _ENDS.values() for x in " ".join(pair).split()}}

# boilerplate by structure
DROPPED = frozenset("nav header footer aside form head menu dialog button select option label fieldset object applet audio video canvas map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_PARTS = "ads?|adverts?|advertisements?|advertising|adsense|adbox|adslot|banner|sponsor(?:ed)?|promo(?:tion|ted)?|cookies?|consent|gdpr|notice|alert|warning-bar|sidebar|side-bar|rail|menu|nav|navbar|navigation|topnav|breadcrumbs?|toc|footer|header|masthead|share|sharing|social|comments?|comment-list|respond|replies|disqus|related|recommended|subscribe|subscription|newsletter|signup|popup|modal|overlay|paywall|widget|pagination|pager|copyright|skip-link|toolbar"
_JUNK = re.compile(rf"(?:{_PARTS})(?:[-_].*)?|.*[-_](?:{_PARTS})", re.I)
_STATE = re.compile(r"(?:has|with|no|is|js|without)[-_]", re.I)

INSIDE, TEXTUAL, BOILERPLATE = 1, 2, 4  # of a line: in a marked article, in a text element, in a dropped element
Line = tuple[str, int]


def _is_junk(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        name = name.lower()
        if name in ("class", "id"):
            if any(_JUNK.fullmatch(x) and not _STATE.match(x) for x in html.unescape(value).split()):
                return True
        elif name == "role" and value.strip().lower() in ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            return True
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _tags(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """``(text before, tag, whether it ends, attributes)``; the last one's tag
    is empty. Comments, declarations and the contents of ``RAW`` elements are left out."""
    at, size, quotes = 0, len(page), True
    lower = page.lower()
    if len(lower) != size:  # some letters change their length: fold A to Z only
        lower = page.translate({c: c + 32 for c in range(65, 91)})
    text: list[str] = []
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            break
        if lt > at:
            text.append(page[at:lt])
        if page.startswith(("!", "?"), lt + 1):
            end = "-->" if page.startswith("!--", lt + 1) else "]]>" if page.startswith("![CDATA[", lt + 1) else ">"
            upto = page.find(end, lt + 4 if end != ">" else lt)
            at = size if upto < 0 else upto + len(end)
            continue
        found = _TAG.match(page, lt + 1) if quotes else None
        if found:
            slash, tag, attributes = found.groups()
            at = found.end()
        else:
            name = _NAME.match(page, lt + 1)
            if not name:
                text.append("<")
                at = lt + 1
                continue
            quotes = False
            slash, tag = name.groups()
            upto = page.find(">", name.end())
            if upto < 0:  # the page ends within a tag
                at = size
                break
            attributes, at = page[name.end() : upto], upto + 1
        tag, ends = tag.lower(), bool(slash)
        if tag in RAW:
            if not ends and not attributes.endswith("/"):
                upto = lower.find(f"</{tag}", at)
                upto = page.find(">", upto) if upto >= 0 else -1
                at = size if upto < 0 else upto + 1
            continue
        yield "".join(text), tag, ends, attributes
        text.clear()
    if at < size:
        text.append(page[at:])
    yield "".join(text), "", False, ""


def page_lines(page: str | None) -> list[Line]:
    """``(line, flags)`` of every block, in page order. One pass, without recursion."""
    lines: list[Line] = []
    buffers: tuple[list[str], list[str]] = ([], [])  # text of the line, and dropped text beside it
    stack: list[tuple[str, int, dict[str, int]]] = [("", 0, {})]  # tag, flags, where what a tag would end is open
    open_: defaultdict[str, int] = defaultdict(int)

    def flush() -> None:
        if not buffers[0] and not buffers[1]:
            return
        for buffer, drop in zip(buffers, (0, BOILERPLATE)):
            if buffer:
                line = " ".join(html.unescape("".join(buffer)).split())
                buffer.clear()
                if line:
                    lines.append((line, stack[-1][1] & ~BOILERPLATE | drop))

    def shut(upto: int, within_line: bool = False) -> None:
        if not within_line:
            flush()
        for x in stack[upto:]:
            open_[x[0]] -= 1
        del stack[upto:]

    for text, tag, ends, attributes in _tags(page or ""):
        if text:
            buffers[bool(stack[-1][1] & BOILERPLATE)].append(text)
        if not tag:
            break
        if ends:
            if open_[tag] > 0:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                shut(i, all(x[0] not in BLOCK for x in stack[i:]))
            elif tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        for of in ("p", tag) if tag in _SHUTS_P else (tag,):
            if (i := stack[-1][2].get(of, 0)) > 0:
                shut(i)
        _, flags, ended = stack[-1]
        junk = flags & BOILERPLATE or (BOILERPLATE if _is_junk(tag, attributes) else 0)
        inside = flags & INSIDE or (INSIDE if tag in ARTICLE and not junk else 0)
        textual = TEXTUAL if tag in TEXT else (flags & TEXTUAL if tag not in BLOCK else 0)
        if tag in _MARKS:
            marks, hides = _MARKS[tag]
            ended = ended | dict.fromkeys(hides, 0) | dict.fromkeys(marks, len(stack))
        stack.append((tag, junk | inside | textual, ended))
        open_[tag] += 1
    flush()
    return lines


def line_hashes(lines: list[Line]) -> list[int]:
    """64-bit hashes of the lines' texts."""
    import xxhash

    return [xxhash.xxh64_intdigest(line) - (1 << 63) for line, _ in lines]


class _Bits:
    """Where each line is in ``b``, one bit a place. Only those of frequent lines are kept."""

    def __init__(self, b: list[int]):
        self.size = len(b)
        self.at: dict[int, list[int]] = {}
        for j, x in enumerate(b):
            self.at.setdefault(x, []).append(j)
        self.kept: dict[int, int] = {}

    def of(self, x: int) -> int:
        if x in self.kept:
            return self.kept[x]
        places = self.at[x]
        if len(places) == 1:
            return 1 << places[0]
        row = np.zeros(self.size, np.uint8)
        row[places] = 1
        bits = int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")
        if len(places) > OFTEN:
            self.kept[x] = bits
        return bits


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with every prefix of ``b``."""
    where, full = _Bits(b), (1 << len(b)) - 1
    flat = full
    for x in a:
        if x in where.at:
            hit = flat & where.of(x)
            flat = ((flat + hit) | (flat - hit)) & full
    grows = np.unpackbits(np.frombuffer(flat.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)] == 0
    return np.concatenate([[0], np.cumsum(grows)])


def shared_lines(own: list[int], other: list[int]) -> list[int]:
    """Positions in ``own`` of one longest common subsequence with ``other``.

    Row by row one bit per line of ``other`` tells where the subsequence's
    length does not grow; the rows are kept, and the alignment is read from
    the end: a bit that turns 0 in a row is a match of that row's line. Where
    the rows would take more than ``DIRECT_BITS``, ``own`` is halved, ``other``
    cut where both halves together align best, and both parts are aligned."""
    found: list[int] = []
    todo = [(0, len(own), 0, len(other))]
    while todo:
        lo, hi, b_lo, b_hi = todo.pop()
        while lo < hi and b_lo < b_hi and own[lo] == other[b_lo]:
            found.append(lo)
            lo, b_lo = lo + 1, b_lo + 1
        while lo < hi and b_lo < b_hi and own[hi - 1] == other[b_hi - 1]:
            hi, b_hi = hi - 1, b_hi - 1
            found.append(hi)
        b = other[b_lo:b_hi]
        both = set(b)
        rows = [i for i in range(lo, hi) if own[i] in both]
        if not rows:
            continue
        if len(rows) > 1 and len(rows) * len(b) > DIRECT_BITS:
            mid = rows[len(rows) // 2]
            ahead = _lengths(own[lo:mid], b)
            behind = _lengths(own[mid:hi][::-1], b[::-1])[::-1]
            cut = b_lo + int((ahead + behind).argmax())
            todo += [(lo, mid, b_lo, cut), (mid, hi, cut, b_hi)]
            continue
        where, full = _Bits(b), (1 << len(b)) - 1
        flat, states = full, []
        for i in rows:
            hit = flat & where.of(own[i])
            flat = ((flat + hit) | (flat - hit)) & full
            states.append(flat)
        r, j = len(rows) - 1, len(b) - 1
        while r >= 0 and j >= 0:
            if states[r] >> j & 1:
                j -= 1
            elif r and not states[r - 1] >> j & 1:
                r -= 1
            else:
                found.append(rows[r])
                r, j = r - 1, j - 1
    return sorted(found)


def site_lines(own: list[int], others: list[list[int]]) -> list[int]:
    """Positions of the lines that any of the neighbours shares, but for copies of the page."""
    gone: set[int] = set()
    for other in others:
        shared = shared_lines(own, other)
        if len(shared) < len(own):
            gone.update(shared)
    return sorted(gone)


def main_lines(lines: list[Line], shared: list[int]) -> tuple[list[str], int, int]:
    """The lines that stay, how many differencing deletes, and how many only structure does."""
    marked = any(flags & INSIDE and not flags & BOILERPLATE for _, flags in lines)
    stays = lambda flags: marked and flags & (INSIDE | TEXTUAL | BOILERPLATE) == INSIDE | TEXTUAL
    gone = {i for i in shared if not stays(lines[i][1])}
    left = [(line, flags) for i, (line, flags) in enumerate(lines) if i not in gone]
    kept = [line for line, flags in left if not flags & BOILERPLATE and (flags & INSIDE or not marked)]
    return kept, len(gone), len(left) - len(kept)


def _url(url: Column) -> tuple[Column, Column]:
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), "[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1))
    path = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return host, path


def _numbered(pages: DataFrame) -> DataFrame:
    """``pages`` in the order of host and path over all of them, with their place ``i``. The
    order is dealt out by ranges, so a large host spreads over many tasks."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))], [*batch.schema.names, "part", "at"])
            at += n

    ordered = pages.repartitionByRange("host", "path", "k1", "k2").sortWithinPartitions("host", "path", "k1", "k2").select("k1", "k2", "host", "lines")
    placed = stash(ordered.mapInArrow(counted, "k1 long, k2 long, host string, lines array<long>, part int, at long"), "html-order")
    start, begins = 0, []
    for part, count in sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect()):  # one row per task
        begins.append((part, start))
        start += count
    begin = pages.sparkSession.createDataFrame(begins, "part int, begin long")
    return placed.join(F.broadcast(begin), "part").select((F.col("begin") + F.col("at")).alias("i"), "host", "k1", "k2", "lines")


def _compared(pages: DataFrame) -> DataFrame:
    """``(k1, k2, shared)`` of numbered pages: positions of the lines that neighbours share."""
    block = F.floor(F.col("i") / BLOCK_PAGES)
    at_hand = F.array_distinct(F.transform(F.sequence(F.lit(-NEIGHBOURS), F.lit(NEIGHBOURS)), lambda d: F.floor((F.col("i") + d) / BLOCK_PAGES)))
    dealt = pages.select(F.explode(F.filter(at_hand, lambda x: x >= 0)).alias("block"), "i", "host", "k1", "k2", "lines", block.alias("home"))
    dealt = dealt.select("block", "i", (F.col("block") == F.col("home")).alias("own"), "host", "k1", "k2", "lines").repartition("block").sortWithinPartitions("block", "i")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: deque[dict] = deque()
        out: list[tuple[int, int, list[int]]] = []

        def settle(at: int) -> None:
            page = window[at]
            if page["own"]:
                others = [x["lines"] for j, x in enumerate(window) if 0 < abs(j - at) <= NEIGHBOURS and x["host"] == page["host"]]
                out.append((page["k1"], page["k2"], site_lines(page["lines"], others)))

        def drain() -> None:
            for at in range(max(0, len(window) - NEIGHBOURS), len(window)):
                settle(at)
            window.clear()

        def given() -> pa.RecordBatch:
            k1, k2, shared = (list(x) for x in zip(*out)) if out else ([], [], [])
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(shared, pa.list_(pa.int32()))], ["k1", "k2", "shared"])

        for batch in batches:
            for at in range(batch.num_rows):
                page = batch.slice(at, 1).to_pylist()[0]
                if window and window[-1]["block"] != page["block"]:
                    drain()
                window.append(page)
                if len(window) > NEIGHBOURS:
                    settle(len(window) - 1 - NEIGHBOURS)
                if len(window) > 2 * NEIGHBOURS:
                    window.popleft()
            yield given()
        drain()
        yield given()

    return dealt.mapInArrow(run, "k1 long, k2 long, shared array<int>")


def extract_main_text(pages: DataFrame, *, differencing: bool = True) -> DataFrame:
    """``(page_id, url, text, n_chars, n_lines, n_shared, n_marked)`` per row of
    ``pages`` (page_id, url, html). Without ``differencing`` structure alone decides."""
    null = [F.col(c).isNull() for c in ("page_id", "url", "html")]
    keys = [F.xxhash64("page_id", "url", "html", *null).alias("k1"), F.xxhash64(F.lit(7), *null, "html", "url", "page_id").alias("k2")]
    pages = pages.select("page_id", "url", "html", *keys)
    host, path = _url(F.col("url"))

    @F.pandas_udf("array<long>")
    @tidy
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield pd.Series([line_hashes(page_lines(p)) for p in some], dtype=object)

    @F.pandas_udf("text string, n_lines int, n_shared int, n_marked int")
    @tidy
    def left(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for some, gone in batches:
            rows = []
            for page, shared in zip(some, gone, strict=True):
                lines = page_lines(page)
                kept, by_site, by_mark = main_lines(lines, [] if shared is None else list(shared))
                rows.append((" ".join(kept), len(lines), by_site, by_mark))
            yield pd.DataFrame(rows, columns=["text", "n_lines", "n_shared", "n_marked"])

    if differencing:
        narrow = stash(pages.select("k1", "k2", host.alias("host"), path.alias("path"), hashes("html").alias("lines")), "html-lines")
        pages = pages.join(_compared(_numbered(narrow.dropDuplicates(["k1", "k2"]))), ["k1", "k2"], "left")
    else:
        pages = pages.withColumn("shared", F.lit(None).cast("array<int>"))
    out = pages.select("page_id", "url", left("html", "shared").alias("r"))
    return out.select("page_id", "url", "r.text", F.length("r.text").cast("long").alias("n_chars"), "r.n_lines", "r.n_shared", "r.n_marked")
