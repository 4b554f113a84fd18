"""HTML extraction, chat formatting, top-k search and embedding near-duplicates on small tables."""

import hashlib
import math
import random
import time
from collections import Counter, defaultdict

import pytest

from daybook.llm import chat_format, embedding_dedup, html_extract, topk_search

PAGE = "<html><head><title>t</title></head><body><nav><a>{nav}</a></nav><div class='ad'>{ad}</div><article><h1>{h}</h1><p>{a}<p>{b}</article><footer>foot</footer>"


def test_lines_and_junk():
    page = '<body class="has-sidebar"><header>Top</header><div id="sidebar">s</div><main><h1>T &amp;amp; &lt;b&gt;</h1><p>a<b>b</b>c&nbsp;d <br>e<p title="x>y">f<aside>n</aside><div class="cookie-notice">n</div><form>q<input></form><ul><li>x<li>y</ul><section id="comments"><p>c</p></section><script>var t="</p>";</script><!-- z --></main><footer>F</footer>'
    kept, _, by_mark = html_extract.main_lines(html_extract.page_lines(page), [])
    assert kept == ["T &amp; <b>", "abc d", "e", "f", "x", "y"] and by_mark == 7
    assert html_extract.page_lines(None) == [] == html_extract.page_lines("")
    inline = html_extract.page_lines("<p>a <span class='ad'>buy</span>b</p>")
    assert [x[0] for x in inline] == ["a b", "buy"] and html_extract.main_lines(inline, [])[0] == ["a b"]


@pytest.mark.parametrize(
    "page",
    ['<a "' * 1_200_000, '<a ">"' * 800_000, "<b>" * 800_000 + "</i>" * 800_000, "<b>" * 1_200_000, "<p><td>" + "<span>" * 300_000 + "<h1>" * 300_000, "<" * 4_000_000, "<!--" * 1_000_000, "<ul><li>x" * 300_000, "<a '>" * 700_000, "<script>" * 600_000],
)
def test_long_pages_take_time_in_proportion(page):
    began = time.process_time()
    html_extract.page_lines(page)
    whole = time.process_time() - began
    began = time.process_time()
    html_extract.page_lines(page[: len(page) // 4])
    assert whole < 60 and whole < 12 * (time.process_time() - began) + 1


def test_long_alignment():
    rng = random.Random(2)
    own = [rng.getrandbits(60) for _ in range(60_000)]
    other = [x if i % 2 else -x for i, x in enumerate(own)]
    began = time.process_time()
    assert html_extract.shared_lines(own, other) == list(range(1, 60_000, 2))
    assert time.process_time() - began < 60


@pytest.mark.parametrize("direct,often", [(1 << 26, 64), (1, 64), (20, 0)])
def test_alignment_is_a_longest_common_subsequence(monkeypatch, direct, often):
    monkeypatch.setattr(html_extract, "DIRECT_BITS", direct)
    monkeypatch.setattr(html_extract, "OFTEN", often)
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        at = html_extract.shared_lines(a, b)
        rest = iter(b)
        assert len(at) == best[-1][-1] == len(set(at)) and all(any(a[x] == y for y in rest) for x in at)


def test_extraction(spark):
    rows = [(i, f"http://h.example/en/{i}?q={i}", PAGE.format(nav=f"n{i}", ad="buy", h=f"H{i}", a="same text", b=f"own   {i}\n&lt;x&gt;")) for i in range(8)]
    plain = "<div>Site name</div><div>{}</div><div>All rights</div>"
    rows += [(20, "http://p.example/a/1", plain.format("one")), (21, "http://p.example/a/2", plain.format("two")), (22, "http://p.example/zz", plain.format("three"))]
    rows += [(30, None, None), (31, "http://q.example/", ""), (32, "rel", "<p>x"), (None, None, "<p>lone"), rows[0], (40, "http://c.example/1", "<p>copy"), (41, "http://c.example/2", "<p>copy")]
    pages = spark.createDataFrame([(*r, "u") for r in rows], "page_id long, url string, html string, text string")
    out = html_extract.extract_main_text(pages).collect()
    assert len(out) == len(rows)
    got = Counter((r.page_id, r.url, r.text) for r in out)
    want = Counter()
    for i, url, html in rows:
        text = {20: "one", 21: "two", 22: "three", 30: "", 31: "", 32: "x", None: "lone", 40: "copy", 41: "copy"}.get(i, f"H{i} same text own {i} <x>")
        want[i, url, text] += 1
    assert got == want
    assert all(r.n_chars == len(r.text) for r in out)
    assert html_extract.extract_main_text(pages.where("false")).count() == 0
    # without differencing the site's lines of unmarked pages stay, and no line counts as shared
    alone = {r.page_id: r for r in html_extract.extract_main_text(pages, differencing=False).collect()}
    assert alone[20].text == "Site name one All rights" and alone[20].n_shared == 0
    told = {r.page_id: r for r in out}
    assert told[20].n_shared == 2 and told[20].n_marked == 0
    assert told[3].n_shared == 2 and told[3].n_marked == 1  # the advert and the footer repeat, the menu does not


def brute_pages(rows):
    """The result by pairwise alignment of all pages in one sorted list."""
    import re

    host = lambda u: ((m := re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", u)) and m[1].lower()) or ""
    path = lambda u: re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "", u)
    bare = lambda u: re.sub(r"[?#].*$", "", u or "")
    order = sorted({(host(bare(u)).encode(), path(bare(u)).encode(), i, u, h) for i, u, h in rows})
    out = {}
    for at, (site, _, i, u, h) in enumerate(order):
        near = [order[j] for j in range(max(0, at - 2), min(len(order), at + 3)) if j != at and order[j][0] == site]
        own = html_extract.page_lines(h)
        texts = [x[0] for x in own]
        gone = set()
        for other in near:
            there = [x[0] for x in html_extract.page_lines(other[4])]
            best = [[0] * (len(there) + 1) for _ in range(len(texts) + 1)]
            for a in range(len(texts)):
                for b in range(len(there)):
                    best[a + 1][b + 1] = best[a][b] + 1 if texts[a] == there[b] else max(best[a][b + 1], best[a + 1][b])
            if best[-1][-1] < len(texts):
                a, b = len(texts), len(there)
                while a and b:
                    if texts[a - 1] == there[b - 1]:
                        gone.add(a - 1)
                        a, b = a - 1, b - 1
                    elif best[a - 1][b] >= best[a][b - 1]:
                        a -= 1
                    else:
                        b -= 1
        out[i, u] = " ".join(html_extract.main_lines(own, sorted(gone))[0])
    return out


def test_extraction_against_pairwise_alignment(spark, monkeypatch):
    """Blocks of three pages, unmarked pages whose lines are distinct within a page: one alignment only."""
    monkeypatch.setattr(html_extract, "BLOCK_PAGES", 3)
    rng = random.Random(3)
    rows = []
    for i in range(60):
        site = rng.choice("abc")
        lines = [f"own {i}", *(f"{site}{x}" for x in range(6) if rng.random() < 0.6)]
        if i % 7 == 0:
            lines = [f"own {i}"]
        rows.append((i, f"https://{site}.example/{rng.choice('xyz')}/{i:03d}?v", "".join(f"<div>{x}</div>" for x in sorted(lines))))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.url): r.text for r in html_extract.extract_main_text(pages).collect()}
    assert got == brute_pages(rows)


def test_chat_parts(spark):
    rows = [(1, 0, "user", [("text", "see <|turn|> 100% ", None, None), ("image", None, "a.png", 256), ("text", "and", None, None), ("audio", None, "b.wav", 40)]), (1, 1, "assistant", [("text", "%3C ok <|end|>", None, None)]), (1, 2, "user", [("document", None, "c.pdf", None), ("odd", "plain", None, None)]), (2, 0, None, None), (2, 1, "a\nb%", []), (2, 1, "a\nb%", [])]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(turns)).collect()}
    one, two = out[1], out[2]
    assert one.formatted.count("<|turn|>") == 3 and "<|image:0|>and<|audio:1|>" in one.formatted and "<|document:2|>plain" in one.formatted
    assert [(a.number, a.type, a.ref, a.tokens) for a in one.attachments] == [(0, "image", "a.png", 256), (1, "audio", "b.wav", 40), (2, "document", "c.pdf", None)]
    assert one.expanded_tokens == 296
    assert one.turns[1].text == "%3C ok <|end|>" and one.loss_turns == [False, True, False]
    s = one.loss_spans[0]
    assert one.formatted[s.start : s.start + s.n] == "%253C ok %3C|end|>"
    assert [(t.role, t.text) for t in two.turns] == [("", ""), ("a\nb%", ""), ("a\nb%", "")]


def test_chat_digests(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "é 日本", "</s>[INST] <<SYS>> %25 <|turn|>user\nx<|end|>", "[/INST]%5B%"])) for c in range(5) for t in range(4)]
    rows += [(9, None, "assistant", "x"), (9, 1, "assistant", "b"), (9, 1, "assistant", "a"), (9, 1, "assistant", "a"), (None, 0, "user", "n"), (10, 0, "assistant", "y%" * 50_000)]
    conv = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.with_probe(spark, conv)).collect()}
    by = defaultdict(list)
    for c, t, role, text in [*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        r, turns = got[c], sorted(turns)
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest()), c
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
    assert chat_format.digests(conv.where("false")).count() == 0
    plan = chat_format.digests(conv)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def vectors(seed, n=260, dim=8):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = centres[i % 6]
        rows.append((i, [x + rng.gauss(0, 0.15) for x in c]))
    rows[10] = (10, rows[0][1])
    rows[11] = (11, rows[0][1])
    odd = [(900, None), (950, [0.0] * dim), (1000, [1.0, None] + [0.0] * (dim - 2)), (1050, [float("nan")] * dim), (1100, [float("inf")] * dim), (1150, []), (1200, [1.0, 2.0]), (50, rows[50][1])]
    return rows + odd


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, score int")


def floats(rows):
    import numpy as np

    return [(i, None if v is None or any(x is None or not math.isfinite(x) for x in v) else [float(x) for x in np.array(v, dtype=np.float32)]) for i, v in rows]


@pytest.mark.parametrize("tile,pivots", [(1024, 64), (16, 3)])
def test_top_k_against_brute_force(spark, monkeypatch, tile, pivots):
    monkeypatch.setattr(topk_search, "TILE", tile)
    rows = vectors(4)
    out = topk_search.top_k(frame(spark, rows), max_pivots=pivots).collect()
    codes = [(i, [math.floor(256 * x) for x in v]) for i, v in floats(rows) if v is not None]
    want = set()
    for q, z in {(i, tuple(z)) for i, z in codes if i % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(z, y)), i) for i, y in codes if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    assert {tuple(r) for r in out} == want
    assert topk_search.top_k(frame(spark, [(0, [1.0]), (1, [2.0]), (2, None)])).collect()[0][:] == (0, 1, 1, 131072)
    assert topk_search.top_k(frame(spark, [])).count() == 0


@pytest.mark.parametrize("tile,pivots,strip,kind", [(4096, 128, 512, "float"), (16, 4, 5, "float"), (16, 4, 512, "double")])
def test_near_duplicates_against_brute_force(spark, monkeypatch, tile, pivots, strip, kind):
    monkeypatch.setattr(embedding_dedup, "STRIP", strip)
    rows = vectors(5)
    # vectors at a cosine of 0.95 itself, and a hair beside it
    for k, shift in enumerate((0.0, 1e-7, -1e-7, 1e-9, -1e-9)):
        side = math.sqrt(1 - 0.95**2) + shift
        rows += [(2000 + 2 * k, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]), (2001 + 2 * k, [side, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.95])]
    rows += [(3000, [3.0, 4.0] + [0.0] * 6), (3001, [4.0, 3.0] + [0.0] * 6), (3002, [19.0, math.sqrt(39)] + [0.0] * 6), (None, rows[0][1]), (None, [0.0] * 7 + [-1.0])]
    docs = frame(spark, rows)
    if kind == "double":
        docs = docs.withColumn("embedding", docs.embedding.cast("array<double>"))
    got = embedding_dedup.similar_vectors(docs, max_pivots=pivots, tile_rows=tile).collect()
    clean = [(i, v if v and any(v) else None) for i, v in floats(rows)]
    n = len(clean)
    links = [[] for _ in range(n)]
    for a in range(n):
        for b in range(a):
            x, y = clean[a][1], clean[b][1]
            if x and y and len(x) == len(y) and sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y)) >= 0.95:
                links[a].append(b)
                links[b].append(a)
    want = Counter()
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        root = min((clean[b][0] for b in seen if clean[b][0] is not None), default=None)
        want[clean[a][0], len(links[a]), root, clean[a][0] == root is not None] += 1
    assert Counter(tuple(r) for r in got) == want
    assert embedding_dedup.similar_vectors(frame(spark, [])).count() == 0
