"""Language ID, quality, Jaccard join, mixing, SentencePiece, LM scoring on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from daybook.llm import jaccard_join, lang_id, lm_scoring, mixing, piece_codec, quality_crf
from daybook.llm.common import bounded_rows

EN = "the cat sat on the mat and it was happy with the house of them this is good"
FR = "le chat est sur la table et il est content avec la maison de nous cela est bon"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string"


def table(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), 0.5, "x") for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        lang, base = (("en", EN), ("fr", FR))[i % 2]
        words = base.split()
        rows.append((i, "\n".join(" ".join(rng.choices(words, k=8)) for _ in range(4)), lang, f"s{i % 3}"))
    rows += [(100, None, "en", "s0"), (101, "", None, None), (102, "  \n ", "fr", "s0"), (103, "123 !!", "en", "s9"), (104, "²³", "en", "s1"), (None, rows[0][1], None, "s1"), (3, rows[3][1], "fr", "s0"), (105, "the mat " * 40_000, "en", "s0")]
    return table(spark, rows)


EMPTY = []


def test_language(spark, docs):
    out = {(r.doc_id, r.lang_pred, r.held_out): r.score for r in lang_id.identify(docs).collect()}
    assert len(list(lang_id.identify(docs).collect())) == docs.count()
    for (i, pred, held), score in out.items():
        assert 0 <= score <= 1
        if i is not None:
            assert held == (zlib.crc32(str(i).encode()) % 4 == 2)
            if i < 60:
                assert pred == ("en", "fr")[i % 2]
            if i in (100, 101, 102, 103, 104):
                assert pred == "und" and score == 0
    kept = lang_id.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None, 105, *range(60)}
    assert lang_id.identify(table(spark, EMPTY)).count() == 0
    unlabelled = table(spark, [(1, "abc", None, None)])
    assert [r.lang_pred for r in lang_id.identify(unlabelled).collect()] == ["und"]


def test_language_backs_off():
    model = lang_id.LangModel(["a", "b"], {"known": 0}, None, {"xyz": 0, "z": 1}, None, max_n=3)
    assert lang_id._unseen(model, "wxyz") == [0]
    assert lang_id._unseen(model, "zq") == [1]
    assert lang_id._unseen(model, "q") == []


@pytest.mark.parametrize("lengths", [[1], [3, 1, 0, 2]])
def test_forward_backward_against_enumeration(lengths):
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    pair = rng.normal(size=(2, 2))
    spans = np.concatenate([[0], np.cumsum(lengths)])
    unary = rng.normal(size=(spans[-1], 2))
    for group in quality_crf._padded(spans):
        scores, n = quality_crf._pad(unary, spans, group)
        log_z, nodes, edges = quality_crf._forward_backward(scores, n, pair)
        for k, d in enumerate(group):
            own = unary[spans[d] : spans[d + 1]]
            paths = list(itertools.product((0, 1), repeat=len(own)))
            weights = np.array([math.exp(sum(own[t, y] for t, y in enumerate(p)) + sum(pair[a, b] for a, b in zip(p, p[1:]))) for p in paths])
            assert math.isclose(log_z[k], math.log(weights.sum()))
            for t in range(len(own)):
                good = sum(w for p, w in zip(paths, weights) if p[t]) / weights.sum()
                assert math.isclose(nodes[k, t, 1], good)
            want = np.zeros((2, 2))
            for p, w in zip(paths, weights):
                for a, b in zip(p, p[1:]):
                    want[a, b] += w / weights.sum()
            assert np.allclose(edges[k], want)


def test_quality(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bad = table(spark, [(200 + i, "\n".join(" ".join(w.upper() + "!!" for w in EN.split()) for _ in range(3)), "en", "s0") for i in range(30)])
    both = docs.unionByName(bad)
    labels = spark.createDataFrame([(i, 1 if i < 200 else 0, 0) for i, t in rows if i is not None and i < 60] + [(200 + i, 0, 1) for i in range(30)] + [(None, 1, 0), (999, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_crf.score_quality(both, labels).collect()
    assert len(out) == both.count()
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            if r.doc_id < 60:
                assert r.predicted == 1
            if r.doc_id >= 200 or r.doc_id in (100, 101, 102):
                assert r.predicted == 0
    assert quality_crf.keep_good(both, labels).columns == both.columns
    assert quality_crf.score_quality(table(spark, EMPTY), labels).count() == 0
    none = quality_crf.score_quality(docs, labels.where("false"))
    assert {r.score for r in none.collect()} == {0.0, 0.5}


def brute_components(rows, percent=90):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return Counter((d, len(sets[i]), min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows))


def near_copies(seed):
    """Texts with exact copies, near copies in chains, one frequent passage, and very short ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(30)]
    rows, base = [], [word() for _ in range(70)]
    for i in range(90):
        kind = i % 6
        if kind == 0:
            text = base[:]
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
        elif kind == 1:
            base = base[:]
            base[rng.randrange(len(base))] = word()
            text = base
        elif kind == 2:
            text = passage + [word() for _ in range(rng.randint(0, 3))]
        elif kind == 3 and rows:
            text = (rows[rng.randrange(len(rows))][1] or "").split()
        elif kind == 4:
            text = [word() for _ in range(rng.randint(0, 4))]
        else:
            text = [word() for _ in range(40)] + passage[:10]
        joined = rng.choice([" ", "\n", "\t "]).join(text)
        rows.append((i, joined.upper() if rng.random() < 0.2 else joined))
    rows += [(500, None), (501, ""), (502, " \t"), (None, rows[0][1]), (None, "lone null id row here"), (1, rows[1][1]), (503, "é É"), (504, "É é")]
    return rows


@pytest.mark.parametrize("seed,max_hot,block,large", [(1, 200_000, 512, 32), (2, 0, 4, 5)])
def test_jaccard_against_brute_force(spark, monkeypatch, seed, max_hot, block, large):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    rows = near_copies(seed)
    out = jaccard_join.similar_components(table(spark, [(i, t, None, None) for i, t in rows]), max_hot=max_hot)
    assert Counter(tuple(r) for r in out.collect()) == brute_components(rows)


def split_group(seed):
    """Texts A, B, C of one prefix and size: B and C are similar, A (the head of the group) is similar to neither."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    shingler = jaccard_join.Shingler(3)
    while True:
        a = [word() for _ in range(30)]
        b = [word(), *a[1:-1], word()]
        c = [word(), *b[1:]]
        texts = [" ".join(x) for x in (a, b, c)]
        sets = [m for _, m in shingler.sets(pa.array(texts))]
        head = min(map(jaccard_join._identity, sets))
        if len({m[:6].tobytes() for m in sets}) == 1 and {len(m) for m in sets} == {28} and head == jaccard_join._identity(sets[0]):
            return texts


@pytest.mark.parametrize("large", [32, 2])
def test_jaccard_links_within_a_group(spark, monkeypatch, large):
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    a, b, c = split_group(4)
    rows = [(1, a), (2, b), (3, c)]
    alone = jaccard_join.similar_components(table(spark, [(i, t, None, None) for i, t in rows]))
    assert Counter(tuple(r) for r in alone.collect()) == brute_components(rows) == Counter([(1, 28, 1), (2, 28, 2), (3, 28, 2)])
    rows = near_copies(4) + [(601, a), (602, b), (603, c)]
    among = jaccard_join.similar_components(table(spark, [(i, t, None, None) for i, t in rows]))
    assert Counter(tuple(r) for r in among.collect()) == brute_components(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_links_of_single_groups(spark, seed):
    """A text; the same with its last word changed; the same with six words changed near its end."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = []
    for i in range(120):
        a = [word() for _ in range(102)]
        rows += [(3 * i, " ".join(a)), (3 * i + 1, " ".join([*a[:-1], word()])), (3 * i + 2, " ".join([*a[:-9], *(word() for _ in range(6)), *a[-3:]]))]
    out = jaccard_join.similar_components(table(spark, [(i, t, None, None) for i, t in rows]))
    assert Counter(tuple(r) for r in out.collect()) == brute_components(rows)


def test_jaccard_family_of_unlike_texts(spark):
    """Sets that share most members, all in the same large buckets, but are not similar: they do not come as pairs."""
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 330, dtype=np.uint64)
    sets = [np.concatenate([base, rng.integers(0, 2**64, 65, dtype=np.uint64)]) for _ in range(60)]
    sets.append(np.concatenate([sets[0][:380], rng.integers(0, 2**64, 15, dtype=np.uint64)]))  # similar to the first
    cells = [np.bincount((s % 1024).astype(int), minlength=1024) & 1 for s in sets]
    packed = lambda c: bytearray(np.packbits(c.astype(np.uint8)).tobytes())
    rows = [(t, i, 395, t, i, 61, packed(c), packed(c.reshape(4, 256).sum(0) & 1)) for t in range(20) for i, c in enumerate(cells)]
    entries = spark.createDataFrame(rows, "token long, key long, n int, pos int, comp long, m long, wide binary, small binary")
    met = Counter((r.a, r.b) for r in jaccard_join._across(entries, Fraction(80, 100), bitmaps=True).collect())
    assert met[0, 60] == 20 and sum(met.values()) < 200


def test_jaccard_long_texts_and_forgotten_groups(spark, monkeypatch):
    """Texts longer than a slice, and prefixes sent again as a task forgets its groups."""
    monkeypatch.setattr(jaccard_join, "SLICE", 2000)
    monkeypatch.setattr(jaccard_join, "SEEN_GROUPS", 3)
    rng = random.Random(8)
    long = [f"w{rng.randrange(50_000)}" for _ in range(120_000)]
    rows = near_copies(7) + [(700, " ".join(long)), (701, " ".join(["x", *long[1:]])), (702, " ".join(long[:60_000])), (703, "one " * 50_000)]
    out = jaccard_join.similar_components(table(spark, [(i, t, None, None) for i, t in rows]))
    assert Counter(tuple(r) for r in out.collect()) == brute_components(rows)


def test_jaccard_empty_and_stage(spark):
    assert jaccard_join.similar_components(table(spark, EMPTY)).count() == 0
    rows = near_copies(3)
    docs = table(spark, [(i, t, None, None) for i, t in rows])
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    clash = docs.withColumnRenamed("lang", "gone_id").withColumnRenamed("source", "tkey").withColumn("row", docs.n_chars).withColumn("a.b", docs.n_chars)
    again = jaccard_join.keep_one(clash)
    assert again.columns == clash.columns and again.count() == kept.count()
    rows.append((2, rows[4][1]))  # one id with two texts: each row stands for itself
    docs = table(spark, [(i, t, None, None) for i, t in rows])
    kept = jaccard_join.keep_one(docs)
    want = Counter(d for d, _, c in brute_components(list(dict.fromkeys(rows))).elements() if d == c)  # equal rows are one
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_codec_equals_library():
    import sentencepiece

    path = piece_codec.default_model()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = piece_codec.PieceCodec(open(path, "rb").read())
    rng = random.Random(3)
    texts = ["", " ", "   ", "a  b ", "\t\n x", "▁x ▁", "日本語 漢字", "🎉 e", "<s> </s> <0x41>", "a" * 500, " " * 40 + "x", "\u0000a", "x　y", "aaaa bbbb lll ://"]
    texts += ["".join(rng.choices("abcdeinost .,▁é日!0 ", k=rng.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == lib.encode(t), t
        assert codec.decode(ids) == lib.decode(ids), t


def test_round_trip(spark, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    want = Counter()
    for (i, t), c in texts.items():
        ids = lib.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += c
    assert Counter(tuple(r) for r in piece_codec.round_trip(docs, piece_codec.default_model()).collect()) == want
    assert piece_codec.round_trip(table(spark, EMPTY), piece_codec.default_model()).count() == 0
    both = docs.limit(5).select("text", piece_codec.encoder(spark, piece_codec.default_model())("text").alias("ids"))
    back = both.select("text", piece_codec.decoder(spark, piece_codec.default_model())("ids").alias("back")).collect()
    assert all((r.text or "") == r.back for r in back)


def test_mixing_against_brute_force(spark, docs):
    out = mixing.assign(docs, entropy_share=0.99, max_repeats=3.0).collect()
    assert len(out) == docs.count()
    rows = [(r.doc_id, r.source, r.n_tokens, r.order_key, r.copies, r.weight) for r in out]
    total = sum(r[2] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    paid = {s: sum(r[2] for r in v) for s, v in by.items()}
    some = {s for s, t in paid.items() if t}
    weights = {s: v[0][5] for s, v in by.items()}
    assert math.isclose(sum(weights.values()), 1, abs_tol=1e-9)
    entropy = -sum(w * math.log(w) for w in weights.values() if w)
    repeats = max(weights[s] * total / paid[s] for s in some)
    assert repeats <= 3.0 + 1e-3
    alphas = {round((math.log(weights[a]) - math.log(weights[b])) / (math.log(paid[a]) - math.log(paid[b])), 4) for a in some for b in some if paid[a] != paid[b]}
    assert len(alphas) == 1 and 0 <= alphas.pop() <= 1
    assert entropy >= 0.99 * math.log(len(some)) - 1e-6 or repeats >= 3.0 - 1e-2
    for s, v in by.items():
        if s not in some:
            assert all(r[4] == 1 for r in v)
            continue
        budget = math.floor(weights[s] * total)
        passes, rest = divmod(budget, paid[s])
        cum, want = 0, {}
        groups = defaultdict(list)
        for r in v:
            groups[r[3] % 2**64, r[3], r[0]].append(r)
        over = False
        for key in sorted(groups, key=lambda k: (k[0], k[2] is not None, k[2] or 0)):
            cum += sum(r[2] for r in groups[key])
            over = over or cum > rest
            want[key[1:]] = passes + (not over)
        assert all(r[4] == want[r[3], r[0]] for r in v), s
    mixed = mixing.mix(docs, entropy_share=0.99, max_repeats=3.0)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: c for k, c in ((i, sum(r[4] for r in rows if r[0] == i)) for i in {r[0] for r in rows}) if c})
    assert mixing.assign(table(spark, EMPTY)).count() == 0


def test_mixing_of_one_repeated_id(spark):
    """A source whose rows all have one id, or none: they rank equally and are taken or left together."""
    rows = [(1, "a b c", None, "s")] * 500 + [(None, "a b", None, "t")] * 300 + [(i, "x y z", None, "u") for i in range(40)]
    docs = table(spark, rows).withColumn("_row", F.lit(1)).withColumn("h", F.lit("x")).withColumn("_mix_source", F.lit(2))
    out = mixing.assign(docs, entropy_share=0.9).collect()
    copies = {s: {r.copies for r in out if r.source == s} for s in "stu"}
    assert len(copies["s"]) == len(copies["t"]) == 1
    mixed = mixing.mix(docs, entropy_share=0.9)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)


def test_bounded_rows_bounds_rows(spark):
    """One id repeated 100,000 times among others."""
    docs = spark.range(100_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("a b "), "id").alias("text")).unionByName(spark.range(100, 400).select(F.col("id").alias("doc_id"), F.lit("x y").alias("text")))
    some = bounded_rows(docs, "doc_id", 1000)
    assert some.count() == 304 and some.columns == docs.columns
    assert bounded_rows(docs, "doc_id", 10).count() <= 13


def test_lm_scores_against_plain_counts(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40)] + [(7, 1, 1), (9, 1, 0), (9, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = lm_scoring.cross_entropy_difference(docs, labels, max_words=1000, bits=20).collect()
    rows = docs.collect()
    assert len(out) == len(rows)
    good = {i for i in range(40) if i % 2}
    words = lambda t: (t or "").lower().split()
    vocab = {w for r in rows for w in words(r.text)}
    assert len(vocab) < 1000
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for r in rows:
        m = int(r.doc_id in good)
        w = words(r.text)
        uni[m].update(w)
        bi[m].update(zip(w, w[1:]))
    scale = sum(uni[1].values()) / sum(uni[0].values())
    size = len(vocab) + 1

    def p(m, prev, w):
        f = scale if m == 0 else 1
        base = (f * uni[m][w] + 0.5) / (f * sum(uni[m].values()) + 0.5 * size)
        if prev is None:
            return base
        return (min(f * bi[m][prev, w], f * uni[m][prev]) + 2 * base) / (f * uni[m][prev] + 2)

    want = {}
    for r in rows:
        w = words(r.text)
        ce = [-sum(math.log(p(m, a, b)) for a, b in zip([None, *w], w)) / len(w) if w else 0.0 for m in (1, 0)]
        want[r.doc_id] = (len(w), *ce)
    for r in out:
        n, target, back = want[r.doc_id]
        assert r.n_tokens == n and abs(r.ce_target - target) < 1e-3 and abs(r.ce_background - back) < 1e-3 and abs(r.ce_diff - (target - back)) < 2e-3
    assert lm_scoring.cross_entropy_difference(table(spark, EMPTY), labels).count() == 0


def test_lm_counts_every_word_and_bigram(spark, monkeypatch):
    """More words than 50,000 and more bigrams than 2**20, in many chunks."""
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 1 << 20)
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(60_000):x}" for _ in range(6000)), None, None) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(table(spark, rows), labels).collect()}
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for i, t, _, _ in rows:
        w = t.split()
        uni[1 - i % 2].update(w)
        bi[1 - i % 2].update(zip(w, w[1:]))
    size = len(uni[0] | uni[1]) + 1
    assert size > 50_001 and len(bi[0] | bi[1]) > 1 << 20
    assert uni[0].total() == uni[1].total()  # so the background's counts stay as they are
    for i, t, _, _ in rows[:20]:
        w = t.split()
        for m, got in ((0, out[i].ce_background), (1, out[i].ce_target)):
            mass = uni[m].total() + 0.5 * size
            base = lambda x: (uni[m][x] + 0.5) / mass  # noqa: B023, E731
            want = -math.log(base(w[0])) - sum(math.log((bi[m][a, b] + 2 * base(b)) / (uni[m][a] + 2)) for a, b in zip(w, w[1:]))
            assert math.isclose(got, want / len(w), rel_tol=1e-9)


def test_piece_codec_is_kept_by_its_worker(monkeypatch):
    """The next task of a worker loads no model again, and finds what the last one has learned."""
    loaded = []

    class Counted(piece_codec.PieceCodec):
        def __init__(self, *args):
            loaded.append(args)
            super().__init__(*args)

    monkeypatch.setattr(piece_codec, "PieceCodec", Counted)
    monkeypatch.setattr(piece_codec, "_kept", [])
    with open(piece_codec.default_model(), "rb") as f:
        model = f.read()
    first = piece_codec.codec_of(model, 1000).texts_of("the cat é一 sat-on")
    again = piece_codec.codec_of(bytes(bytearray(model)), 1000)
    assert again.texts_of("the cat é一 sat-on") == first and len(loaded) == 1
    piece_codec.codec_of(model, 2000)
    assert len(loaded) == 2 and len(piece_codec._kept) == 1
